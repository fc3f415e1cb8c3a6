import random

from tidewatch.llm import snapshots


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    key = lambda v: tuple((x is not None, x if x is not None else 0) for x in v)
    seqs = {c: [v[1:] for v in sorted(ts, key=key)] for c, ts in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(o[: len(s)] == s and (len(o) > len(s) or d < c) for d, o in seqs.items() if d != c):
            continue
        out[c] = (len(s), "".join(f"<|{'unknown' if r is None else r}|>\n{x or ''}\n" for r, x in s))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = {}
    for r in sorted(snapshots.formatted(df).collect(), key=lambda r: r.part):
        n, t = got.get(r.conv_id, (r.n_turns, ""))
        got[r.conv_id] = (n, t + r.text)
    return got


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice("ab")))
    rows += [(None, 0, "user", "x"), (70, None, None, None), (71, None, "unknown", None), (72, None, None, ""), (73, 0, "user", "a"), (73, 0, "user", "a")]
    assert run(spark, rows) == brute(rows)


def test_long_conversation_spans_blocks(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BLOCK", 4)
    rows = [(1, t, "user", str(t)) for t in range(30)] + [(2, t * 3, "user", str(t)) for t in range(29)] + [(3, t, "user", str(t)) for t in range(1, 30)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [(None, 1, "a", "b")]) == {}
