import random
import re

import numpy as np

from tidewatch.llm import fm_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, it in items:
            v = words(it)
            for s in range(max(1, len(v) - k + 1) if v else 0):
                win = v[s : s + k]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def make(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "Cé", "d1", "x"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.choice([2, 5, 13, 20, 16]))) for i in range(10)] + [(10, None), (11, ".."), (12, "ü"), (7, "Q q")]
    docs = [(i, line(rng.randint(0, 120)) + rng.choice(["", ". ", "-" + items[i % 9][1]])) for i in range(40)]
    return docs + [(90, None), (91, ""), (92, "!"), (93, items[3][1].upper()), (94, "x " * 3000)], items


def test_suffix_array_and_locate_against_sorting():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 2), (400, 3), (300, 1), (500, 200)):
        text = rng.integers(1, k + 1, n)
        full = [*text.tolist(), 0]
        assert fm_index.suffix_array(np.array(full)).tolist() == sorted(range(n + 1), key=lambda i: full[i:])
        index = fm_index.FmIndex(text, k)
        pattern = text[n // 2 : n // 2 + 3]
        live, low, high = index.search(pattern, np.array([0]), np.array([len(pattern)]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [i for i in range(n) if full[i : i + len(pattern)] == pattern.tolist()]


def check(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items), r.contaminated) for r in fm_index.contamination(d, b, words=k).collect()}
    assert got == brute(docs, items, k)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        check(spark, *make(seed), 13)
    check(spark, *make(3), 4)


def by_row(docs, items, k):
    """brute() of rows one by one, for ids that repeat."""
    return sorted((str(i), *map(str, brute([(i, t)], items, k)[i])) for i, t in docs)


def found_rows(spark, docs, items, k, kind="long"):
    d, b = spark.createDataFrame(docs, f"doc_id {kind}, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = fm_index.contamination(d, b, words=k).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(list(r.items)), str(r.contaminated)) for r in rows)


def test_blocks_of_phrases_merge(spark, monkeypatch):
    docs, items = make(4)
    docs = docs + [(1, docs[5][1]), (1, docs[5][1]), (None, docs[6][1]), (None, docs[7][1]), (3, docs[8][1])]
    docs += [(500, "a b c x y z"), (500, "p q r s t u")]
    items = items + [(50, "a b c x"), (51, "p q r s")]
    want = by_row(docs, items, 4)
    assert found_rows(spark, docs, items, 4) == want
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", 40)
    assert found_rows(spark, docs, items, 4) == want
    assert found_rows(spark, [(f"d{i}", t) for i, t in docs], items, 4, "string") == by_row([(f"d{i}", t) for i, t in docs], items, 4)


def test_long_items_and_documents_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "PIECE_WORDS", 7)
    docs, items = make(6)
    items += [(20, " ".join(t for _, t in items[:9] if t))]
    assert found_rows(spark, docs, items, 4) == by_row(docs, items, 4)


def test_empty_tables(spark):
    docs, items = make(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert fm_index.contamination(d.limit(0), b).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in fm_index.contamination(d, b.limit(0)).collect())
