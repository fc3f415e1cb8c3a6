import random

import corpus_pipeline
from tests.llm import test_fm_index, test_minhash


def rows(n=60):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    line = lambda k: " ".join(word() for _ in range(k))
    items = [(i, line(30)) for i in range(4)]
    docs = [(i, "\n".join(line(40) for _ in range(4)), "en", f"s{i % 3}") for i in range(n)]
    docs.append((n, docs[3][1], "en", "s0"))
    near = docs[4][1].split(" ")
    near[50] = "changed"
    docs.append((n + 1, " ".join(near), "en", "s1"))
    passage = line(90)
    docs += [(n + 2, line(50) + " " + passage + " " + line(40), "en", "s1"), (n + 3, line(45) + " " + passage + " " + line(60), "en", "s2")]
    docs.append((n + 4, line(30) + " " + items[2][1] + " " + line(30), "en", "s0"))
    docs += [(n + 5, None, None, "s0"), (n + 6, "123 456", "en", None), (n + 7, "", "en", "s1")]
    return docs, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = rows()
    full = [(*d, len(d[1] or "")) for d in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {d[0]: d[1] for d in docs}

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        got[name] = {r.doc_id: r.text for r in now.collect()}
        now = spark.createDataFrame(now.collect(), now.schema)

    lettered = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert got["language_id"] == lettered
    kept = test_minhash.brute(sorted(lettered.items()), 5, 80)
    assert got["near_dedup"] == {i: t for i, t in lettered.items() if kept[i][2]}
    assert 60 not in got["near_dedup"] and 61 not in got["near_dedup"]
    changed = {i for i, t in got["near_dedup"].items() if got["substring_dedup"][i] != t}
    assert changed == {63}
    assert len(got["substring_dedup"][63].split()) == 105
    hit = test_fm_index.brute(list(got["substring_dedup"].items()), items, 13)
    assert got["decontamination"] == {i: t for i, t in got["substring_dedup"].items() if not hit[i][3]}
    assert 64 not in got["decontamination"]

    mixed = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(mixed) == set(got["decontamination"])
    for i, r in mixed.items():
        assert r.size == len(got["decontamination"][i].split())
        assert 0 <= r.taken <= 3 * r.size
    for s in ("s0", "s1", "s2"):
        own = [r for r in mixed.values() if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 200


def test_rows_that_share_an_id_are_judged_each_by_itself(spark, tmp_path):
    docs, items = rows(40)
    bad = docs[-4][1]
    assert items[2][1] in bad
    extra = [(1, docs[0][1]), (5, docs[0][1]), (5, docs[7][1] + " tail"), (None, bad), (2, bad), (2, docs[9][1].replace("e", "f")), (None, docs[11][1].replace("a", "b"))]
    full = [(i, t, "en", "s0", 1, "x") for i, t in [(d[0], d[1]) for d in docs if d[0] < 40] + extra]
    df = spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {corpus_pipeline.ROW} string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda d: sorted((str(r.doc_id), r.text) for r in d.collect())
    all_of_them = sorted((str(r[0]), r[1]) for r in full)
    stages = dict(corpus_pipeline.STAGES)
    # Row (1, text of 0) and row (5, text of 0) go; (5, ...), equal to 7's text but for a word, goes as well.
    gone = sorted([("1", docs[0][1]), ("5", docs[0][1]), ("7", docs[7][1])])
    near = stages["near_dedup"](spark, df, str(tmp_path))
    assert near.columns == df.columns and texts(near) == [r for r in all_of_them if r not in gone]
    clean = stages["decontamination"](spark, df, str(tmp_path))
    assert clean.columns == df.columns and texts(clean) == [r for r in all_of_them if r[1] != bad]


def test_columns_of_the_user_pass_unchanged(spark, tmp_path):
    docs, items = rows(40)
    names = ["score", "lang_pred", "rejected", "cross_entropy", "_rejected", "kept", "start", "words", "component_id"]
    full = [(i, t, "en", "s0", len(t), *(f"{c}{i}" for c in names)) for i, t, *_ in docs if t]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns
        found = now.collect()
        assert len(found) > 35 and all(r[c] == f"{c}{r.doc_id}" for r in found for c in names)
        now = spark.createDataFrame(found, df.schema)
