import math

import numpy as np
import pytest

from tidewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x string"


def run(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame([(*r, "c", "x") for r in rows], schema).repartition(3)
    return whitening.whiten(df, **how).collect()


def grid(v):
    return [math.floor(256 * c) for c in v]


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    data = (rng.normal(size=(400, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] @ rng.normal(size=(6, 6))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900 + i, data[0].tolist()) for i in range(200)]
    bad = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5)]
    got = run(spark, rows + bad)
    assert len(got) == 4 * len(rows)
    x = np.array(sorted({tuple(grid(v)) for _, v in rows}), dtype=object)
    n, total = len(x), x.sum(axis=0)
    f = x.astype(float)
    cov = np.cov(f.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    by_row = {(r.vec_id, r.component): r for r in got}
    for i, v in rows:
        own = np.array(grid(v), dtype=object)
        for k in range(1, 5):
            r = by_row[i, k]
            assert (r.n, int(r.deviation)) == (n, sum((n * own - total) ** 2))
            want = (own.astype(float) - f.mean(axis=0)) @ vectors[:, -k] / math.sqrt(values[-k])
            assert abs(abs(r.whitened) - abs(want)) < 1e-9
            assert abs(r.explained - values[-k] / np.trace(cov)) < 1e-9
            assert r.identity_error < 1e-9
    for k in range(1, 5):
        signs = {np.sign(by_row[i, k].whitened * ((np.array(grid(v)) - f.mean(axis=0)) @ vectors[:, -k])) for i, v in rows}
        assert len(signs - {0}) == 1


def test_merge_formula_is_the_whole():
    rng = np.random.default_rng(1)
    rows = rng.integers(-500, 500, (97, 5)) + 10**6
    whole = whitening.moments(rows)
    parts = [whitening.moments(p) for p in np.split(rows, [1, 40, 41])]
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        m = parts[order[0]]
        for k in order[1:]:
            m = whitening.merged(m, parts[k])
        assert m[0] == whole[0] and list(m[1]) == list(whole[1])
        assert np.allclose(m[2], whole[2], rtol=1e-14) and np.allclose(m[3], whole[3], rtol=1e-11)


def test_few_vectors_and_several_lengths(spark):
    one = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [0.5])])
    assert sorted((r.vec_id or 0, r.component, r.n, int(r.deviation)) for r in one) == [(0, 1, 1, 0), (1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0)]
    assert all(r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    two = run(spark, [(1, [0.0, 1.0, 0.0]), (2, [0.0, 2.0, 0.0])])
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in two) == [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, True), (2, 3, True)]
    assert {abs(r.whitened) for r in two if r.component == 1} == {1.0}


def test_empty_and_only_bad_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [None])]) == []


@pytest.mark.parametrize("scale", [1.0, 2.0**22])
def test_exact_beyond_64_bits(spark, scale):
    rows = [(i, [float(i) * scale, -float(i * i) * scale]) for i in range(50)]
    got = run(spark, rows, SCHEMA.replace("float", "double"))
    x = [grid(v) for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        assert int(r.deviation) == sum((50 * c - s) ** 2 for c, s in zip(x[r.vec_id], total, strict=True))
