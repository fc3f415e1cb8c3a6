import random

from tidewatch.llm import paragraphs
from tidewatch.llm.common import ROW, row_key


def keyed(df):
    return df.withColumn(ROW, row_key("text"))


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    docs = {i: [line(rng.randint(3, 60)) for _ in range(rng.randint(1, 6))] for i in range(60)}
    passages = [[word() for _ in range(n)] for n in (51, 60, 90, 120, 200)]
    planted = {}
    for k, p in enumerate(passages):
        for d in (5 * k, 5 * k + 1, 5 * k + 3):
            w = docs[d][0].split()
            at = rng.randint(0, len(w))
            docs[d][0] = " ".join(w[:at] + p + w[at:])
            planted.setdefault(k, []).append(d)
    near = line(80).split()
    docs[40].append(" ".join(near))
    docs[41].append(" ".join(near[:70] + ["changed"] + near[71:]))
    docs[50] = ["short line of boiler plate text that many have"] * 20
    docs[51] = ["short line of boiler plate text that many have"]
    return [(i, "\n".join(v)) for i, v in docs.items()] + [(100, None), (101, ""), (102, "x " * 3000), (None, "a b c")], passages, planted


def test_spliced_passages_and_near_lines(spark):
    rows, passages, planted = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row_key int")
    spans = paragraphs.repeats(df)
    found = spans.collect()
    texts = dict(rows)
    want = {(d, min(v)) for v in planted.values() for d in v if d != min(v)} | {(41, 40)}
    assert {(r.doc_id, r.owner) for r in found} == want
    for r in found:
        assert r.n_words == r.end - r.start >= 40
    left = {r.doc_id: r.text for r in paragraphs.remove(df, spans).select("doc_id", "text").collect()}
    assert len(left) == len({i for i, _ in rows})
    for k, docs in planted.items():
        passage = " ".join(passages[k])
        for d in docs:
            if d == min(docs):
                assert left[d] == texts[d]
            else:
                a, b = texts[d].split(passage)
                # A line that is near enough the owner's goes as a whole.
                assert left[d] == a + b or (passage not in left[d] and (a + b).endswith(left[d][-50:]))
    for d in set(texts) - {r.doc_id for r in found}:
        assert left[d] == texts[d]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.repeats(df).collect() == []


def test_segments_of_a_text_do_not_depend_on_its_neighbours():
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (1, 40, 7, 300, 12, 6, 90)]
    first = np.cumsum([0, *map(len, rows)])
    together = paragraphs.segment_starts(np.concatenate(rows), first)
    for row, a, b in zip(rows, first[:-1], first[1:], strict=True):
        assert (together[a:b] == paragraphs.segment_starts(row, np.array([0, len(row)]))).all()


def test_near_lines_that_are_far_from_the_centre_of_their_buckets(spark):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(84)]

    def variant(changes, base):
        w = list(base)
        for at in rng.sample(range(2, 82), changes):
            w[at] = f"v{rng.randrange(10**9)}"
        return w

    rows = []
    for k in range(150):
        first = variant(3, template)
        second = list(first)
        second[rng.randrange(2, 82)] = f"v{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(80)} for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in range(a):
            if near(a, b) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    want = {(i, root(i)) for i in sets if root(i) != i}
    assert 100 < len(want) < 290
    df = keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.owner) for r in paragraphs.repeated_lines(df, 25, 80).collect()}
    assert got == want


def test_passages_are_those_of_one_earlier_document(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = {}
    # Phrases of the passage's ends stand in still earlier documents, in other words.
    for k in range(20):
        passage = words(55)
        texts[10 * k] = words(30) + passage[:22] + words(30) + passage[33:] + words(30)
        texts[10 * k + 1] = words(25) + passage + words(25)
        texts[10 * k + 2] = words(35) + passage + words(9)
    # Phrases of many documents that abut in none of them.
    for k in range(20):
        phrases = [words(30) for _ in range(4)]
        for i, p in enumerate(phrases):
            texts[1000 + 10 * k + i] = words(20) + p + words(20)
        texts[1000 + 10 * k + 9] = words(5) + sum(phrases, []) + words(5)
    # The bound, and a document's own repeats.
    for k in range(20):
        passage = words(40)
        texts[2000 + 10 * k] = passage + words(1)
        texts[2000 + 10 * k + 1] = words(30) + passage + words(30)
        texts[2000 + 10 * k + 2] = words(30) + passage[1:] + words(30)
        texts[2000 + 10 * k + 3] = passage
    texts[3000] = words(50) * 3
    first = {}
    for d, t in sorted(texts.items()):
        for i in range(len(t) - 39):
            first.setdefault(tuple(t[i : i + 40]), d)
    want = {(d, i + j) for d, t in texts.items() for i in range(len(t) - 39) if first[tuple(t[i : i + 40])] < d for j in range(40)}
    df = keyed(spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string"))
    spans = paragraphs.repeated_passages(df, 40).collect()
    assert {(r.doc_id, i) for r in spans for i in range(r.start, r.end)} == want
    for r in spans:
        run, owner = texts[r.doc_id][r.start : r.end], texts[r.owner]
        assert r.owner < r.doc_id and len(run) >= 40 and any(owner[i : i + len(run)] == run for i in range(len(owner)))


def test_rows_that_share_an_id(spark):
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    first, second, own = words(60), words(45), words(50)
    rows = [
        (1, words(30) + " " + first), (2, first + " " + words(200)), (2, "short"), (2, words(20) + "\n" + second),
        (3, second), (3, words(300) + " " + first + "\n" + words(5)), (4, own), (4, own + " " + words(30)), (None, first), (5, None),
    ]
    for kind in ("long", "string"):
        df = spark.createDataFrame([(i if i is None or kind == "long" else f"d{i}", t, k) for k, (i, t) in enumerate(rows)], f"doc_id {kind}, text string, cuts int")
        spans = paragraphs.repeats(df)
        got = {r.cuts: r.text for r in paragraphs.remove(df, spans).collect()}
        want = {k: t for k, (_, t) in enumerate(rows)}
        want[1] = want[1][len(first) :]
        want[4] = ""
        want[5] = want[5].replace(first, "")
        assert got == want


def test_lines_of_a_crowded_family(spark):
    """Lines with 86 of 100 words in common, of which some have a copy with one word changed."""
    rng = random.Random(31)
    common = [f"t{i}" for i in range(86)]
    rows = []
    for i in range(500):
        w = list(common)
        for at in sorted(rng.sample(range(86), 14)):
            w.insert(at, f"v{rng.randrange(10**9)}")
        rows.append((i, w))
        if i < 60:
            copy = list(w)
            copy[rng.randrange(3, 97)] = f"v{rng.randrange(10**9)}"
            rows.append((10_000 + i, copy))
    df = keyed(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    got = {(r.doc_id, r.owner) for r in paragraphs.repeated_lines(df, 25, 80).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(96)} for i, w in rows}
    want = {(10_000 + i, i) for i in range(60) if 100 * len(sets[i] & sets[10_000 + i]) >= 80 * len(sets[i] | sets[10_000 + i])}
    assert len(want) > 50 and got == want
