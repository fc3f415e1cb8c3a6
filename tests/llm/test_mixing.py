import itertools
import random
import time

import pytest

from tidewatch.llm import mixing


def brute_targets(sizes, weights, total, most):
    out, capped = {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        unit = left / max(1e-12, sum(weights[s] for s in sizes if s not in capped))
        over = {s for s in sizes if s not in capped and unit * weights[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else unit * weights[s] for s in sizes}
        capped |= over


def test_targets_reshare_the_excess():
    sizes, weights = {"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 2, "c": 3}
    got = mixing.targets(sizes, weights, 1015, 3)
    assert got == pytest.approx(brute_targets(sizes, weights, 1015, 3))
    assert got["c"] == 15 and got["a"] == 30


def test_flow_prefers_first_uses_and_fills_overlaps():
    used = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 120, "b": 90}, 3)
    assert sum(used.values()) == 210
    assert used == {("a",): 100, ("a", "b"): 100, ("b",): 10}
    used = mixing.route({("a",): 10, ("b",): 10}, {"a": 25, "b": 1}, 3)
    assert used == {("a",): 25, ("b",): 1}


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "x " * (i % 37 + 1), ["s1", "s2", "s3", None][i % 4], i) for i in range(2000)] + [(None, None, "s1", 0), (7, "", "s2", 1), (7, "", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.sources[0] or "")
    assert sorted(got, key=key) == sorted(again, key=key)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        t = by.setdefault(r.sources[0], [0, 0, r.target, r.source_size])
        t[0] += r.taken
        t[1] += r.size
    for taken, size, target, source_size in by.values():
        assert size == source_size
        assert abs(taken - target) <= 37


def test_overlapping_sources_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", ["x", "y"]), (2, "c", []), (3, "d e f", ["y", "x", "x"])], "doc_id long, text string, source array<string>")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert got[1].sources == got[3].sources == ["x", "y"]
    assert got[2].sources == [None]
    assert mixing.mix(docs.limit(0)).collect() == []


def exhaustive(patterns, quotas, repeats):
    """(most words that can be routed, least cost of routing them) over all whole amounts."""
    names, best = list(patterns), None
    fits = lambda some, used: sum(used[p] for p in some) <= sum(quotas[s] for s in {s for p in some for s in p})
    subsets = [c for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]
    for amounts in itertools.product(*(range(patterns[p] * repeats + 1) for p in names)):
        used = dict(zip(names, amounts, strict=True))
        if all(fits(c, used) for c in subsets):  # Hall's condition: these amounts can be routed
            cost = sum(k * k * min(max(used[p] - k * patterns[p], 0), patterns[p]) for p in names for k in range(repeats))
            if best is None or (-sum(amounts), cost) < best:
                best = -sum(amounts), cost
    return -best[0], best[1]


def test_flow_against_exhaustive_minima():
    rng = random.Random(4)
    for _ in range(40):
        sources = "abc"[: rng.randint(1, 3)]
        sets = [c for k in range(1, len(sources) + 1) for c in itertools.combinations(sources, k)]
        patterns = {p: rng.randint(1, 4) for p in rng.sample(sets, min(len(sets), rng.randint(1, 4)))}
        quotas = {s: rng.randint(0, 9) for s in sources}
        used = mixing.route(patterns, quotas, 3)
        cost = sum(k * k * min(max(used[p] - k * n, 0), n) for p, n in patterns.items() for k in range(3))
        assert (sum(used.values()), cost) == exhaustive(patterns, quotas, 3)


def test_flow_of_many_patterns_ends_soon():
    rng = random.Random(6)
    patterns = {tuple(sorted(rng.sample(range(40), rng.randint(1, 4)))): rng.randint(1, 10**6) for _ in range(1500)}
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in range(40)}
    quotas = mixing.targets(sizes, {s: s % 3 + 1 for s in sizes}, sum(patterns.values()), 3)
    began = time.time()
    used = mixing.route(patterns, quotas, 3)
    assert time.time() - began < 60
    assert abs(sum(used.values()) - sum(patterns.values())) <= len(sizes)
