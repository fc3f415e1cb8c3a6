import math
from collections import Counter

import numpy as np

from tidewatch.llm import language_id as li


def brute_probability(texts, gram):
    """Interpolated Kneser-Ney straight from its definition, on strings."""
    padded = ["\0" * 3 + t for t in texts]
    full = Counter(p[i - 3 : i + 1] for p in padded for i in range(3, len(p)))
    levels = {4: full}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    p = 1 / (len(levels[1]) + 1)
    for n in (1, 2, 3, 4):
        c = levels[n]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, ones / (ones + 2 * twos) if ones else 0.5)
        g = gram[4 - n :]
        following = [v for k, v in c.items() if k[:-1] == g[:-1]]
        if following:
            p = max(c[g] - d, 0) / sum(following) + d * len(following) / sum(following) * p
    return p


def pack(g):
    key = 0
    for ch in g:
        key = key << 16 | (0 if ch == "\0" else ord(ch))
    return key


def test_probabilities_match_the_definition():
    texts = ["abracadabra", "barbara", "cab", "éa"]
    keys, _ = li.grams(texts)
    u, c = np.unique(keys, return_counts=True)
    model = li.KneserNey(u, c)
    for g in ("abra", "\0\0\0a", "zzzz", "\0\0ca", "bara", "zabr", "adaé"):
        assert math.isclose(model.probability(np.array([pack(g)], np.uint64))[0], brute_probability(texts, g), rel_tol=1e-9)


def test_grams_collapse_other_characters():
    keys, first = li.grams(["A,, b", None, "!!", "..x"])
    assert first.tolist() == [0, 3, 3, 3, 4]
    assert keys.tolist() == [pack("\0\0\0a"), pack("\0\0a\0"), pack("\0a\0b"), pack("\0\0\0x")]


def test_identifies_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs.filter("crc32(cast(doc_id as string)) % 4 <> 2"))
    rows = li.identify(docs, model).filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) == 0


def test_edge_cases_and_rejection(spark):
    train = [(i, "the cat and the dog sat on the mat again " * 3, "en") for i in range(30)] + [(100 + i, "der hund und die katze sind auf der matte " * 3, "de") for i in range(30)] + [(500, "zzz", None), (None, None, "fr")]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !!", 5), (4, "the cat sat", 5), (5, "qxzj wvqk zxqj kqwx vzqx jjqz " * 5, 5)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in li.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert [got[i].rejected for i in (1, 2, 3, 4, 5)] == [True, True, True, False, True]
    nothing = li.fit(docs.limit(0))
    assert [r.lang_pred for r in li.identify(odd, nothing).collect()] == ["und"] * 5
    assert li.identify(odd.limit(0), model).collect() == []


def test_an_unseen_language_is_rejected_and_known_ones_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs.filter("lang <> 'fr' and crc32(cast(doc_id as string)) % 4 <> 2"))
    assert "fr" not in model.languages
    rows = li.identify(docs.filter("length(text) > 100"), model).select("lang", "rejected").collect()
    strange, known = [r.rejected for r in rows if r.lang == "fr"], [r.rejected for r in rows if r.lang != "fr"]
    assert sum(strange) > 0.9 * len(strange) > 20 and sum(known) <= 0.005 * len(known)


def test_sample_is_bounded_and_copies_teach_once(spark):
    rows = [(i, "le chat et le chien " + "abcdefgh"[i % 8] * (i % 5 + 1), "fr") for i in range(400)] + [(None, "der hund", "de")] * 50 + [(7, "x" * 5000, "en"), (7, "the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    counted = li._counted

    def watch(sample):
        seen.append({r.lang: (r["n"], r["c"]) for r in sample.groupBy("lang").agg({"*": "count", "text": "max"}).toDF("lang", "n", "c").collect()})
        return counted(sample)

    li._counted = watch
    try:
        li.fit(docs, fit_rows=50, fit_chars=1000)
    finally:
        li._counted = counted
    assert 20 <= seen[0]["fr"][0] <= 50 and seen[0].get("de", (1,))[0] == 1 and seen[0].get("en", (1,))[0] == 1


def test_letters_beyond_the_basic_plane_have_codes_of_their_own():
    keys, _ = li.grams([chr(0x10330) + "a"])
    high = int(keys[0]) & 0xFFFF
    assert 0xD800 <= high < 0xF900 and int(keys[1]) == high << 16 | ord("a")


def test_limits_follow_one_rule_at_any_number_of_documents():
    rng = np.random.default_rng(0)
    counts = {x: (np.arange(1, 5, dtype=np.uint64), np.ones(4, int)) for x in ("a", "b", "c")}

    def limits(held):
        model = li.Model.of(["a", "b", "c"], counts)
        h = np.concatenate([1.5 + rng_a[:held], 1.8 + rng_b])
        model.calibrate(np.r_[np.zeros(held, int), np.ones(len(rng_b), int)], np.full(len(h), 1000), h)
        return model.limits

    rng_a, rng_b = rng.normal(0, 0.05, 400), rng.normal(0, 0.05, 400)
    found = [limits(n) for n in (0, 1, 29, 30, 31, 400)]
    assert all(1.5 < f[0] < 2.2 and 1.8 < f[1] < 2.3 for f in found)
    assert abs(found[2][0] - found[3][0]) < 0.01 and abs(found[3][0] - found[4][0]) < 0.01  # no jump at any size
    assert all(1.6 < f[2] < 2.3 for f in found)  # without own documents: as the others
    blind = li.Model.of(["a"], counts)
    blind.calibrate(np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    assert blind.limits[0] == np.log(blind.models[0].symbols)


def test_without_a_common_table_the_values_are_the_same(monkeypatch):
    texts = ["the cat and the dog", "der hund und die katze", "zzz", None]
    counts = {x: np.unique(li.grams([t])[0], return_counts=True) for x, t in (("en", texts[0]), ("de", texts[1]))}
    with_table = li.Model.of(["de", "en"], counts).cross_entropies(texts)
    monkeypatch.setattr(li, "TABLE_CELLS", 1)
    alone = li.Model.of(["de", "en"], counts)
    assert alone.logs.shape[0] == 0
    assert all(np.allclose(a, b) for a, b in zip(with_table, alone.cross_entropies(texts), strict=True))


def test_columns_of_the_user_stay_under_a_prefix(spark):
    docs = spark.createDataFrame([(1, "the cat", 0.5, "mine")], "doc_id long, text string, score double, lang_pred string")
    model = li.fit(spark.createDataFrame([(i, "the cat and the dog " * 9, "en") for i in range(20)], "doc_id long, text string, lang string"))
    (row,) = li.identify(docs, model, prefix="_").collect()
    assert (row.score, row.lang_pred, row["_lang_pred"]) == (0.5, "mine", "en")
