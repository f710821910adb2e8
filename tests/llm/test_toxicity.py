import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from piiflow.llm import toxicity as T

BAD = ("vrat", "skulk", "moggo")


def corpus(n, seed=1, share=0.3):
    """Documents of made-up words; every third or so holds some of BAD, or of a family of words that begin alike."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(1 + len(text) // 15):
                text.insert(rng.randrange(len(text)), rng.choice([*BAD, "zorf" + "".join(rng.choice("aeiou") for _ in range(4))]))
        docs.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return docs, labels


def plain_steps(rows, margin, slack):
    """The model by plain dictionaries."""
    n, parent = [Counter(), Counter()], {}
    for toxic, text in rows:
        here = set()
        for w in set(T._words(text)):
            before = ""
            for e in T.expressions(w):
                here.add(e)
                parent[e] = before
                before = e
        n[toxic].update(here)
    d = [min(0.95, max(0.1, s[1] / (s[1] + 2 * s[2]) if s[1] + s[2] else 0.75)) for s in (Counter(c.values()) for c in n)]
    below = defaultdict(list)
    for e, p in parent.items():
        below[p].append(e)
    steps = {}
    for p, es in below.items():
        kinds = sum((n[0][e] > 0) + (n[1][e] > 0) for e in es)
        for e in es:
            backoff = ((n[0][e] > 0) + (n[1][e] > 0)) / kinds
            prob = []
            for c in (0, 1):
                total = sum(n[c][x] for x in es)
                some = sum(n[c][x] > 0 for x in es)
                prob.append((max(n[c][e] - d[c], 0) + d[c] * some * backoff) / total if total else backoff)
            r = math.log(prob[1] / prob[0])
            left = abs(r) - slack - margin * math.sqrt(1 / (n[0][e] + 0.5) + 1 / (n[1][e] + 0.5))
            if left > 0:
                steps[e] = math.copysign(left, r)
    return steps


def test_expressions_end_and_nest():
    assert T.expressions("a") == ("a$",)
    assert T.expressions("idiots") == ("id", "idi", "idio", "idiots$")
    assert T.expressions("idiotic") == ("id", "idi", "idio", "idioti", "idiotic$")
    long = T.expressions("x" * 1_000_000)
    assert long[:4] == ("xx", "xxx", "xxxx", "xxxxxx") and len(long[4]) < 120 and long[4] != T.expressions("x" * 1_000_001)[4]


def test_model_against_dictionaries(spark):
    docs, labels = corpus(400)
    rows = [(t, x) for (_, x), (_, t) in zip(docs, labels)] + [(0, None), (1, ""), (0, "word " * 50_000), (1, "y" * 5000)]
    df = spark.createDataFrame(rows, "toxic int, text string")
    got = {r.expression: r.step for r in T.telling(df, 1.0, 0.3).collect()}
    want = plain_steps(rows, 1.0, 0.3)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_expressions_that_are_not_sent_count_alike(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame([*docs, docs[0], docs[1], (None, "vrat a"), (None, None)], "doc_id long, text string")
    model = T.telling(spark.createDataFrame([(t, x) for (_, x), (_, t) in zip(docs, labels)], "toxic int, text string"), 1.0, 0.3)
    whole = sorted((tuple(r) for r in T.log_ratios(df, model).collect()), key=repr)
    parts = sorted((tuple(r) for r in T.log_ratios(df, model, sent=3).collect()), key=repr)
    assert len(whole) == 304 and [a for a, _ in whole] == [a for a, _ in parts]
    assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(whole, parts))
    steps = plain_steps([(t, x) for (_, x), (_, t) in zip(docs, labels)], 1.0, 0.3)
    by_id = dict(whole)
    for k, text in docs[5:60]:
        words = T._words(text)
        assert abs(by_id[k] - sum(steps.get(e, 0) for w in words for e in T.expressions(w)) / len(words)) < 1e-8


def test_held_out_documents(spark):
    docs, labels = corpus(3000, seed=4, share=0.2)
    got = T.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    label = dict(labels)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {k for k in label if zlib.crc32(str(k).encode()) % 3 == 1}
    toxic = [r.predicted for r in out if label[r.doc_id]]
    clean = [r.predicted for r in out if not label[r.doc_id]]
    assert sum(toxic) / len(toxic) > 0.95 and sum(clean) / len(clean) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = corpus(600, seed=7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(k, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in labels]
    one, two = (sorted(map(tuple, T.score(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned))
    assert one == two


def test_odd_tables(spark):
    docs, labels = corpus(300, seed=2)
    rows = [*docs, docs[0], docs[0], (None, "vrat"), (None, None), (9001, ""), (9002, None), (9003, "!! 12"), (9004, "vrat " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "'x' AS score", "2 AS row", "3 AS total", "0 AS ratio", "'en' AS lang")
    known = spark.createDataFrame([*labels, labels[3], (None, 1), (5, None)], "doc_id long, toxic int").selectExpr("*", "'z' AS text")
    got = T.score(df, known).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.held_out, r.score, r.predicted))
    assert len(by[None]) == 2 and not any(h for h, _, _ in by[None])
    assert by[9001] == [(by[9001][0][0], by[9002][0][1], 0)] and by[9003][0][1] == by[9001][0][1]
    assert by[9004][0][2] == 1 and len(by[docs[0][0]]) == 3 and len(set(by[docs[0][0]])) == 1
    empty = T.score(df.limit(0), known)
    assert empty.count() == 0
    none = T.score(df, known.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 0)}


@pytest.mark.parametrize("sample", [[], [(0.1, 1)], [(0.1, 0), (0.1, 1)], [(0.0, 0)] * 50 + [(1.0, 1)] * 50, [(0.5, 0), (0.1, 1)]])
def test_curve_rises_and_is_finite(sample):
    slope, offset = T.curve(sample)
    assert slope >= 0 and math.isfinite(slope) and math.isfinite(offset)
