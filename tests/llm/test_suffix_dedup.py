"""Removed bytes against a dictionary of all 100-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from piiflow.llm import suffix_dedup as S


def brute(rows, length=100):
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen.setdefault(data[k : k + length], (doc, k)) != (doc, k):
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made(spark, rows, **kind):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.remove_repeats(df.repartition(3), **kind).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(passage) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(0, 6))]
        rows.append((k * 3, rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(1, rows[5][1]), (400, rows[5][1]), (401, "a" * 500), (402, "ab" * 90), (403, "a" * 250), (404, None), (405, ""), (406, "x" * 99)]
    unit = " ".join(word() for _ in range(14))
    rows += [(407, unit * 9), (408, "q" + unit * 4), (409, (unit + "z") * 3)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_strings(spark, seed):
    rows = corpus(seed)
    assert made(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot,shard", [(1, S.SHARD_BYTES), (0, 3000), (2, 500), (5, 20_000)])
def test_hot_hashes_are_refined_like_others(spark, monkeypatch, hot, shard):
    rows = corpus(7)
    earlier = S._earlier
    monkeypatch.setattr(S, "_earlier", lambda length: earlier(length, shard))
    assert made(spark, rows, hot_segments=hot) == brute(rows)


def test_edge_cases(spark):
    assert made(spark, []) == []
    long = "".join(chr(97 + k % 23) + chr(97 + (k * k) % 19) for k in range(200))
    df = spark.createDataFrame([(5, long, "x"), (5, long, "y"), (None, long, "z")], "doc_id long, text string, t string")
    got = {(r.doc_id, r.n_removed) for r in S.remove_repeats(df).collect()}
    assert got == {(5, brute([(5, long)])[0][2]), (None, 400)}


@pytest.mark.parametrize("group", [1, 50, 1 << 18])
def test_refined_order_is_that_of_the_suffixes(group):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.integers(97, 99, 400), np.tile(rng.integers(97, 122, 90), 3), np.full(300, 120), np.tile([120, 121], 200), rng.integers(0, 2, 200)]).astype(np.uint8)
    order = S.refine(data, 100, group)
    assert sorted(order.tolist()) == list(range(len(data)))
    whole = bytes(data)
    for a, b in zip(order, order[1:]):
        # Up to 100 bytes, as far as both go.
        k = min(100, len(data) - max(a, b))
        assert whole[a : a + k] <= whole[b : b + k]
    windows = np.arange(0, len(data) - 100 + 1)
    places, same = S.same_windows(data, windows, 100)
    groups: dict = {}
    for k in windows.tolist():
        groups.setdefault(whole[k : k + 100], set()).add(k)
    found = [set(x.tolist()) for x in np.split(places, np.flatnonzero(~same)[1:])]
    assert sorted(map(sorted, found)) == sorted(map(sorted, groups.values()))


def test_long_groups_of_runs_pass_whole():
    import pyarrow as pa

    n = 9000
    names = ["key", "t", "sn", "m"]
    t = np.sort(np.concatenate([np.zeros(5000, np.int64), np.arange(1, n - 5000), [n, n]])[:n])
    columns = [pa.array(np.full(n, 7)), pa.array(t), pa.array(np.full(n, (3 << 32) | (4 << 1))), pa.array(np.zeros(n, np.int64), mask=np.ones(n, bool))]
    batch = pa.RecordBatch.from_arrays(columns, names)
    out = [x for b in S._met(iter([batch.slice(k, 700) for k in range(0, n, 700)])) for x in b["t"].to_pylist()]
    assert set(out) == set(t.tolist())
