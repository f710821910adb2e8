"""Mixing against the iterative rule, written out source by source."""

import random

import pytest
from pyspark.sql import functions as F

from piiflow.llm import mixing


def brute(sizes: dict, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, target, free = budget * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_the_iterative_rule(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 5, 40, 1000, rng.randrange(100_000)]) for k in range(12)} | {None: 77, "é": 300}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute(sizes)
    assert {r.source for r in got} == set(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)


def test_taken_words_meet_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_IN_RANGE", 50)  # many ranges, as in a large source
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(0, 200)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    weights = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    got = mixing.mix(docs, weights).collect()
    assert len(got) == 3000
    sums = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        a, t = sums.get(r.source, (0, r.target))
        sums[r.source] = (a + r.taken, t)
    for taken, target in sums.values():
        assert abs(taken - target) <= 1
    again = mixing.mix(docs.repartition(7), weights).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    # Whole epochs first: beyond them, good documents are taken more often.
    part = [r for r in got if r.target < r.source_size and r.size]
    share = lambda even: sum(r.taken > 0 for r in part if (r.doc_id % 2 == 0) == even) / sum((r.doc_id % 2 == 0) == even for r in part)
    assert not part or share(True) > share(False)


def test_edge_cases(spark):
    schema = "doc_id long, source string, size long"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, None, 0)], schema)).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0)] * 3
    got = mixing.mix(spark.createDataFrame([(1, "a", 10), (1, "a", 10), (None, None, 5)], schema)).collect()
    assert sum(r.taken for r in got) in (37, 38) and len(got) == 3
    texts = spark.createDataFrame([(None,), ("",), (" \t\n",), ("a b c\rd",)], "text string")
    assert [r[0] for r in texts.select(mixing.size_of(F.col("text"))).collect()] == [0, 0, 0, 3]


def test_equal_rows_and_rows_without_identifier(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_IN_RANGE", 10)
    monkeypatch.setattr(mixing, "COPIES_IN_BLOCK", 7)
    rows = [(None, "a", 3, 0)] * 100 + [(5, "a", 2, 0)] * 40 + [(None, "a", 3, k) for k in range(1, 101)] + [(k, "b", 10, 0) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, c long")
    for carried in ((), ("c",)):
        got = mixing.mix(docs, F.when(F.col("doc_id") == 5, 0.01).otherwise(2.0), carried=carried).collect()
        assert len(got) == len(rows)
        for source in "ab":
            mine = [r for r in got if r.source == source]
            assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
            # Whole epochs of all, then whole rows but for the one at the edge.
            epochs = int(mine[0].target // mine[0].source_size)
            assert sum(r.taken - epochs * r.size not in (0, r.size) for r in mine) <= 1
