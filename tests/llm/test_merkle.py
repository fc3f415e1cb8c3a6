import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidewatch.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(nodes, fanout):
    """Top of a list of digests, and the (before, after) steps of each."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for leaf, k in enumerate(at):
            run, i = runs[k // fanout], k % fanout
            steps[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            at[leaf] = k // fanout
        nodes = [h(*run) for run in runs]
    return nodes[0], steps


def brute(rows, fanout):
    groups = {}
    for d, s, g, n, t in rows:
        head = [code(v) for v in (d, s, g, n)]
        leaf = h(*head, code(t))
        struck = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups.setdefault(g, []).append(((d is not None, d or 0, leaf), d, leaf, h(*head, code(lower(t))) if struck else leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: tree([v[2] for v in sorted(groups[g])], fanout) for g in names}
    root, above = tree([tops[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above, strict=True):
        for (_, d, leaf, now), steps in zip(sorted(groups[g]), tops[g][1], strict=True):
            path = steps + up
            for b, a in path:
                now = h(b, now, a)
            out.append((d, leaf, tops[g][0], root, h(*(b + a for b, a in path)), now, now == root))
    return sorted(out, key=str)


def run(spark, rows, fanout=8):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = merkle.verified(merkle.documents_manifest(df, fanout))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en"] * 6 + ["de", None, "", "é", "zz"]), i, rng.choice(["Ab é", "", None, "plain"])) for i in range(300)]
    rows += [(7, None, "en", None, "Again"), (7, None, "en", None, "other"), (None, None, None, None, None), (None, "s", "en", 1, "A"), (5000, "s", "lone", 1, "Only")]
    rng.shuffle(rows)
    got = run(spark, rows)
    assert got == brute(rows, 8)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_sizes_at_the_edges_of_runs(spark):
    for fanout, sizes in ((2, (1, 2, 3, 5)), (8, (1, 8, 9, 65))):
        rows = [(i, "s", f"l{k}", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
        assert run(spark, rows, fanout) == brute(rows, fanout)


def test_one_leaf_is_its_own_root(spark):
    (row,) = run(spark, [(1, "s", "en", 3, "abc")])
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h() and row[6]


def test_repeated_rows(spark):
    rows = [(3, "s", "en", 1, "Same")] * 30 + [(4, "s", "en", 1, "b")]
    assert run(spark, rows) == brute(rows, 8)


def test_empty(spark):
    assert run(spark, []) == []


def test_any_table_and_any_change_is_seen(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("kind"), F.lit("v").alias("value"))
    found = merkle.manifest(rows, F.col("kind"), "k", merkle.leaf(F.col("k"), F.col("value")), F.struct("k"), fanout=4).select("own.k", "leaf", "root", "path")
    wrong = found.withColumn("bad", F.when(F.col("k") == 42, merkle.leaf(F.col("k"), F.lit("w"))))
    assert [r.k for r in wrong.filter(merkle.folded(F.coalesce("bad", "leaf")) != F.col("root")).collect()] == [42]
