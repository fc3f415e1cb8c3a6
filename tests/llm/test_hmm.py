import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import hmm


def small_model(n=5, states=3, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((n, states)), 0))


def brute_paths(m, seq):
    """Sums over all state paths: probability, and expected counts."""
    import itertools

    total, start, move, emit = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros_like(m.emit)
    for path in itertools.product(range(3), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        total += p
        start[path[0]] += p
        for t, s in enumerate(path):
            emit[seq[t], s] += p
            if t:
                move[path[t - 1], s] += p
    return total, start / total, move / total, emit / total


def test_forward_and_expected_counts_against_all_paths():
    m = small_model()
    seqs = [np.array(s, np.uint16) for s in ([0, 1, 4, 2, 2], [3], [1, 1, 0], [2, 4])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros_like(m.emit)
    for places, matrix, lengths in hmm.groups(seqs):
        logs = m.forward(matrix, lengths)[0]
        a, b, c = m.expected(matrix, lengths)
        for k, i in enumerate(places):
            total, x, y, z = brute_paths(m, seqs[i])
            assert math.isclose(logs[k], math.log(total), rel_tol=1e-5)
            start, move, emit = start + x, move + y, emit + z
        assert np.allclose(a, start, atol=1e-4) and np.allclose(b, move, atol=1e-4) and np.allclose(c, emit, atol=1e-4)


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "").split()


def test_base_scores_and_totals(spark):
    rng = random.Random(1)
    words = [f"W{i}é" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 36]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "never seen"), (103, "w1é " * 600)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")
    out = {r.doc_id: r for r in hmm.score(df, F.col("doc_id") % 5 == 2, vocabulary=12).collect()}
    c = Counter()
    for i, t in rows:
        if i % 5 != 2:
            c.update([*lower(t), "\n"])
    total = sum(c.values())
    scale = math.log10(total + 0.1 * (len(c) + 1))
    for i, t in rows:
        tokens = [*lower(t), "\n"]
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 2, len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10(c[w] + 0.1) - scale for w in tokens), rel_tol=1e-9)
        assert r.score < 0


def test_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hmm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).filter("held_out")
    r = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > r.b + 0.05 * r.n


def test_probabilities_of_all_tokens_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a a a b b c c d e f ax bx")], "doc_id long, text string")
    counts = hmm.token_counts(df)
    known = hmm.summary(counts, 3)
    rare = [r for r in counts.collect() if r["class"] >= 0 and r.hash not in set(known.hashes.tolist())]
    for k in range(hmm.CLASSES):
        mine = sum(r.c + 0.1 for r in rare if r["class"] == k)
        assert math.isclose((mine + 0.1) / (known.class_mass[k] + 0.1), 1)
    m = hmm.Hmm.first(known, 4)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert hmm.score(df.limit(0), F.lit(False)).collect() == []
    (r,) = hmm.score(df, F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


def plain_round(model, sequences, prior):
    """One Baum-Welch round from the definition, in double precision, one sequence at a time."""
    k = len(model.start)
    start, move, emit = np.full(k, 0.1), np.full((k, k), 0.1), np.repeat(prior[:, None], k, axis=1)
    for seq in sequences:
        a, b, n = [model.start * model.emit[seq[0]]], [np.ones(k)], len(seq)
        for s in seq[1:]:
            a.append((a[-1] @ model.move) * model.emit[s])
        for s in seq[:0:-1]:
            b.append(model.move @ (model.emit[s] * b[-1]))
        b.reverse()
        total = a[-1].sum()
        for t in range(n):
            gamma = a[t] * b[t] / total
            emit[seq[t]] += gamma
            if t == 0:
                start += gamma
            if t + 1 < n:
                move += a[t][:, None] * model.move * (model.emit[seq[t + 1]] * b[t + 1])[None, :] / total
    return hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_scores_against_a_plain_model(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(words[: 4 + i % 27]) for _ in range(rng.randint(0, 25)))) for i in range(50)] + [(90, None), (91, "unseen w1 w29"), (92, "w2 " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 4 == 1
    got = {r.doc_id: r.score for r in hmm.score(df, held, states=3, rounds=3, vocabulary=9).collect()}

    counts = hmm.token_counts(df.filter(~held))
    known = hmm.summary(counts, 9)
    by_hash = {r.hash: r.c for r in counts.collect()}
    import pyarrow as pa

    def parts(text):
        (found,) = hmm.tokens(pa.array([text or ""]))
        symbols, frequent = known.encode(found[1], found[2])
        within = sum(math.log10((by_hash.get(h, 0) + 0.1) / (known.class_mass[c] + 0.1)) for h, c, f in zip(found[1].tolist(), found[2].tolist(), frequent.tolist(), strict=True) if not f)
        return [*symbols.tolist(), known.n_symbols - 1], within

    model = hmm.Hmm.first(known, 3)
    for _ in range(3):
        model = plain_round(model, [parts(t)[0] for i, t in rows if i % 4 != 1], 0.1 * (known.symbol_counts() + 0.1) / 3)
    for i, t in rows:
        symbols, within = parts(t)
        a = model.start * model.emit[symbols[0]]
        for s in symbols[1:]:
            a = (a @ model.move) * model.emit[s]
        assert math.isclose(got[i], math.log10(a.sum()) + within, rel_tol=2e-4, abs_tol=1e-4)


def test_long_texts_train_as_whole_ones(spark):
    rng = np.random.default_rng(6)
    true = small_model(n=12, states=3, seed=2)
    texts = []
    for n in (600, 256, 257, 2000, 5, 1):
        state, text = rng.choice(3, p=true.start), []
        for _ in range(n):
            text.append(rng.choice(12, p=true.emit[:, state]))
            state = rng.choice(3, p=true.move[state])
        texts.append(np.array(text, np.uint16))
    model, prior = small_model(n=12, states=3, seed=3), np.full(12, 0.01)
    model.move = model.move * 0.2 + np.eye(3) * 0.8
    got = hmm.baum_welch(spark.createDataFrame([(t.tobytes(),) for t in texts], "symbols binary"), model, prior)
    # The plain recursion over whole texts, scaled at each step so that no probability vanishes.
    k, start, move, emit = 3, np.full(3, 0.1), np.full((3, 3), 0.1), np.repeat(prior[:, None], 3, axis=1)
    for seq in texts:
        a, scale, b = [], [], [np.ones(k)]
        for t, s in enumerate(seq):
            x = (model.start if t == 0 else a[-1] @ model.move) * model.emit[s]
            scale.append(x.sum())
            a.append(x / x.sum())
        for t in range(len(seq) - 1, 0, -1):
            b.append(model.move @ (model.emit[seq[t]] * b[-1]) / scale[t])
        b.reverse()
        start += a[0] * b[0]
        for t, s in enumerate(seq):
            emit[s] += a[t] * b[t]
            if t:
                move += a[t - 1][:, None] * model.move * (model.emit[s] * b[t])[None, :] / scale[t]
    assert np.allclose(got.start, start / start.sum(), atol=1e-5)
    assert np.allclose(got.move, move / move.sum(axis=1, keepdims=True), atol=1e-5)
    assert np.allclose(got.emit, emit / emit.sum(axis=0), atol=1e-5)


def test_long_texts_are_scored_in_double_precision(spark):
    model = small_model(n=12, states=3, seed=4)
    text = np.random.default_rng(1).integers(0, 12, 50_000).astype(np.uint16)
    row = (text.tobytes(), 1, False, 0, len(text), 0, 0.0, 0.0)
    schema = "symbols binary, doc_id long, held_out boolean, rid long, n_tokens long, known long, base double, within double"
    (got,) = hmm.likelihoods(spark.createDataFrame([row], schema), model).collect()
    state, log = None, 0.0
    for t, s in enumerate(text):
        state = (model.start if t == 0 else state @ model.move) * model.emit[s]
        log += math.log10(state.sum())
        state = state / state.sum()
    assert math.isclose(got.hmm, log, rel_tol=1e-11)
