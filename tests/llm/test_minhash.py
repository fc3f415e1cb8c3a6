import random

import pytest

from tidewatch.llm import components, minhash


def word_sets(text, k):
    words = (text or "").split()
    lower = [w.lower() for w in words]
    if not lower:
        return frozenset()
    return frozenset(tuple(lower[i : i + k]) for i in range(len(lower) - k + 1)) or frozenset([tuple(lower)])


def brute(rows, k, similarity):
    sets = {i: word_sets(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(n=140):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(20)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text).title() if i % 3 else "\n".join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "two"), (n + 6, "x " * 5000), (n + 7, "X " * 9)]
    return rows


def test_components_of_near_copies_match_brute_force(spark):
    rows = corpus()
    for k in (2, 5):
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words=k).collect()}
        assert got == brute(rows, k, 80)


def test_large_mixed_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus(90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words=2, bands=60, rows=2).collect()}
    assert got == brute(rows, 2, 80)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(df, words=2).collect())
    assert got == [("1", 2, "1", True), ("None", 0, "None", True), ("None", 2, "None", True)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, similarity=79)


def brute_rows(rows, k):
    """By row: (id, set size, smallest id of its component, kept), every row judged by its own text."""
    by_text = {}
    for i, t in rows:
        if i is not None:
            by_text.setdefault(word_sets(t, k), []).append(i)
    sets = [s for s in by_text if s]
    up = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = [y if u == x else u for u in up]
    owner = {}
    for s, u in zip(sets, up, strict=True):
        owner[u] = min([*by_text[s], *([owner[u]] if u in owner else [])])
    of = {s: owner[u] for s, u in zip(sets, up, strict=True)}
    out = []
    for i, t in rows:
        s = word_sets(t, k)
        c = None if i is None else of.get(s, i)
        out.append((str(i), len(s), str(c), i is None or c == i))
    return sorted(out)


def test_rows_that_share_an_id(spark):
    texts = [t for _, t in corpus(60)]
    rng = random.Random(3)
    rows = [(rng.randrange(40), t) for t in texts] + [(None, texts[0]), (1, texts[0]), (1, texts[0]), (200, texts[0])]
    rows += [(501, "a b c d e"), (501, "p q r s t"), (502, "a b c d e"), (503, "p q r s t")]
    for kind in ("long", "string"):
        typed = [(i if kind == "long" or i is None else f"d{i:04}", t) for i, t in rows]
        got = minhash.near_duplicates(spark.createDataFrame(typed, f"doc_id {kind}, text string"), words=2).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_rows(typed, 2)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
