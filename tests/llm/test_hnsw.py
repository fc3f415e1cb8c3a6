import numpy as np

from tidewatch.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, shard string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "i") for r in rows], SCHEMA).repartition(4)


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)


def brute(rows, nth, nearest):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if good(v)]
    out = []
    for at, (q, v) in enumerate(rows):
        if q is None or q % nth:
            continue
        near = []
        for k, (i, w) in enumerate(rows):
            if k != at and len(w) == len(v):
                near.append((-((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i is None, i))
        near.sort(key=lambda t: (t[0], t[1], t[2] or 0))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(near[:nearest])]
    return out


def run(spark, rows, nth=50, **how):
    return [tuple(r) for r in hnsw.every_nth(frame(spark, rows), nth, **how).collect()]


def same(got, want):
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-14, rtol=0)


def test_recall_on_clusters_copies_and_noise(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=(3000, 24))
    centre = rng.normal(size=(1, 24))
    near = centre + rng.normal(size=(1000, 24)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([noise, near, np.repeat(centre, 1000, axis=0)]).astype(np.float32))]
    df = frame(spark, rows)
    index = hnsw.build(df, shard_rows=1500)
    assert index.count() == 4
    found = hnsw.search(index, df.selectExpr("vec_id as query_id", "embedding").filter("query_id % 50 = 0")).collect()
    want, got = brute(rows, 50, 5), {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values()) and len(got) == 100
    hits = sum(got[q][r][1] >= s - 1e-12 for q, r, _, s in want)
    assert hits / len(want) >= 0.97
    copies = [(r, i) for q, r, i, _ in want if q == 4000]
    assert [(r, got[4000][r][0]) for r in range(1, 6)] == copies


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)).astype(np.float32))]
    same(run(spark, rows, 7), brute(rows, 7, 5))


def test_bad_vectors_ties_repeats_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (9, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (4, [1.0, 1.0]), (100, [2.0])]
    bad = [(1, None), (2, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (8, [float("-inf"), 0.0])]
    same(run(spark, rows + bad), brute(rows + bad, 50, 5))
    assert (100, 1) not in {r[:2] for r in run(spark, rows)}


def test_extreme_lengths_of_vectors(spark):
    rows = [(0, [1e-30, 0.0]), (1, [1e30, 1e30]), (2, [1e-30, 1e-32]), (3, [-1e30, 0.0])]
    assert [r[2] for r in sorted(run(spark, rows, 2, nearest=1))] == [2, 0]


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_same_results_again(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 16)).astype(np.float32))]
    assert sorted(run(spark, rows, 5)) == sorted(run(spark, rows[::-1], 5))
