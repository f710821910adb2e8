"""Matches of nothing, chains of overlaps, histories and documents masked one after another, against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from piiflow.operators import candidates as C, catalog, spans as S
from piiflow.plans.masking import mask_corpus
from piiflow.plans.sequential import mask_in_order

NO_VARIABLES = "project_id string, value string, token string, kind string, variable_order long"


@pytest.mark.parametrize("pattern", ["x*y?", "(?:ab)*", "x*?", "a|", "(?<=a)b*", "(?=b)", "b*$", "x+", "[^a]*", "^x*"])
def test_patterns_that_can_match_nothing(spark, pattern):
    rng = random.Random(len(pattern))
    texts = ["", "x", "xx", "abab", "xyxxy", "axbxyb", None, "x\ufdd0y\ufdd1\ufdd0\ufdd1xb", "\ufdd0"] + ["".join(rng.choice("abxy\U0001f600") for _ in range(rng.randrange(25))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.value) for r in S.exploded(df, C.pattern_rule_spans(spark, F.col("text"), [{"id": "p", "pattern": pattern, "kind": "k"}])).collect())
    want = []
    for k, text in enumerate(texts):
        at, compiled = 0, re.compile(pattern)
        while text is not None and at <= len(text) and (m := compiled.search(text, at)):
            if m.group():
                want.append((k, m.start(), m.group()))
                at = m.end()
            else:
                at = m.end() + 1
    assert got == want


def test_values_are_those_of_spans(spark):
    """Also where texts hold the signs that mark matches."""
    rng = random.Random(7)
    texts = ["", None, "\x05", "x\x05y\x06\x05\x06xb", "\x06x\x05\x05x"] + ["".join(rng.choice("abxy\x05\x06\U0001f600 ") for _ in range(rng.randrange(25))) for _ in range(60)]
    texts += ["".join(rng.choice("abxy\U0001f600") for _ in range(rng.randrange(25))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = [{"id": p, "pattern": p, "kind": "k"} for p in ("x*y?", "a|", "(?<=a)b*", "[^a]*", "x+", "(")] + [{"id": "off", "pattern": "b", "kind": "k", "enabled": False}]
    rows = df.select("text", C.pattern_rule_spans(spark, F.col("text"), rules).alias("s"), C.pattern_rule_values(spark, F.col("text"), rules).alias("v")).collect()
    for text, found, values in rows:
        assert [s.value for s in found] == values and all(text[s.start : s.end] == s.value for s in found)
    plain = [m for t in texts if t for p in ("x*y?", "x+") for m in re.findall(p, t) if m]
    assert sorted(s.value for r in rows for s in r.s if s.source in ("pattern:x*y?", "pattern:x+")) == sorted(plain) and rows[1].v == []


def test_places_cost_no_more_in_a_long_text(spark):
    """The same hits in one text and in many: steps between them are computed once, not for each block of the text."""
    n, took = 200_000, {}
    for texts in (200, 200, 1):
        df = spark.range(texts, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("xt"), n // texts).alias("text"))
        spans = S.exploded(df, C.pattern_rule_spans(spark, F.col("text"), [{"id": "p", "pattern": "t*h?e*", "kind": "k"}]))
        began = time.perf_counter()
        assert spans.agg(F.count("*"), F.sum("start")).first() == (n, texts * (n // texts) ** 2)
        took[texts] = time.perf_counter() - began
    assert took[1] < 5 * took[200] + 2


def test_chains_of_overlaps(spark):
    rng = random.Random(3)
    rows = [(d, a, a + rng.randrange(1, 12), "v", "k", "s", rng.choice([0, 1, None]), q) for d in range(30) for q, a in enumerate(rng.randrange(80) for _ in range(40))]
    schema = "doc_id long, start long, end long, value string, kind string, source string, priority int, seq int"
    df = spark.createDataFrame(rows, schema)
    table = sorted((r.doc_id, r.start, r.end, r.seq) for r in S.resolved(df, ["doc_id"]).collect())
    arrays = df.groupBy("doc_id").agg(F.collect_list(F.struct(*df.columns[1:]).cast(S.SPAN)).alias("s"))
    assert table == sorted((r.doc_id, r.start, r.end, r.seq) for r in arrays.select("doc_id", F.inline(S.resolve(F.col("s")))).collect())
    chain = spark.range(50_000).selectExpr("1L AS doc_id", "id * 2 AS start", "id * 2 + 3 + id % 2 AS end", "'v' AS value", "'k' AS kind", "'s' AS source", "0 AS priority", "0 AS seq")
    began = time.perf_counter()
    kept = sorted((r.start, r.end) for r in S.resolved(chain, ["doc_id"]).collect())
    assert len(kept) == 25_000 and all(a[1] <= b[0] for a, b in zip(kept, kept[1:])) and time.perf_counter() - began < 30


def plain_history(ops):
    past, current, future, out, states = [], None, [], [], {None: object()}
    for seq, op, state in ops:
        if op == "switch":
            past, current, future = [], None, []
        elif op == "commit" and states[current] != state:
            past, future = [*past, current], []
            current = seq
            states[seq] = state
        elif op == "undo" and past:
            *past, before = past
            future, current = [*future, current], before
        elif op == "redo" and future:
            *future, after = future
            past, current = [*past, current], after
        out.append((seq, current, bool(past), bool(future)))
    return out


def test_histories(spark):
    rng = random.Random(9)
    logs = {w: [(k, rng.choices(["commit", "undo", "redo", "switch", "go"], [5, 4, 3, 0.4, 1])[0], rng.choice("abc")) for k in range(200)] for w in ("a", "b", None)}
    rows = [(w, *x) for w, ops in logs.items() for x in ops]
    rng.shuffle(rows)
    got = catalog.replay(spark.createDataFrame(rows, "workspace string, seq long, op string, state string"), F.col("state")).collect()
    want = [(w, *x) for w, ops in logs.items() for x in plain_history(ops)]
    assert sorted(((r.workspace, r.seq, r.current, r.can_undo, r.can_redo) for r in got), key=repr) == sorted(want, key=repr)


def test_one_after_another_and_all_at_once(spark):
    rows = [("p", 1, "mr Ann. saw Ann Lee"), ("p", 2, "mr Ann Lee and Bob"), ("p", 3, "mr Bob, Ann Lee"), ("p", 4, None), ("q", 1, "Ann Lee"), (None, 1, "mr Ann")]
    docs = spark.createDataFrame(rows, "project_id string, doc_order long, text string")
    spans = S.find_spans(F.col("text"), r"(?<=mr )[A-Z][a-z]+(?: [A-Z][a-z]+)?", "name", "name", 2)
    none = spark.createDataFrame([], NO_VARIABLES)
    masked, after = mask_in_order(docs, none, spans)
    got = {(r.project_id, r.doc_order): (r.text, r.n_replaced) for r in masked.collect()}
    assert got == {
        ("p", 1): ("mr NAME1. saw NAME1 Lee", 2), ("p", 2): ("mr NAME2 and Bob", 1), ("p", 3): ("mr NAME3, NAME2", 2), ("p", 4): (None, 0), ("q", 1): ("Ann Lee", 0), (None, 1): ("mr Ann", 0),
    }
    assert {r.value: r.token for r in after.collect()} == {"Ann": "NAME1", "Ann Lee": "NAME2", "Bob": "NAME3"}
    # All at once, Ann Lee of the second document is known in the first, and Bob of the third in the second.
    at_once, _ = mask_corpus(docs.filter("project_id = 'p' AND text IS NOT NULL").withColumnRenamed("doc_order", "doc_id"), none, spans)
    assert {r.doc_id: r.text for r in at_once.collect()} == {1: "mr NAME1. saw NAME2", 2: "mr NAME2 and NAME3", 3: "mr NAME3, NAME2"}


def test_variables_that_were_there(spark):
    docs = spark.createDataFrame([("p", 5, "x Eve, y Eves"), ("p", 2, "Eve y Kim")], "project_id string, doc_order long, text string")
    known = spark.createDataFrame([("p", "Eve", "NAME2", "name", 1), ("r", "Kim", "NAME9", "name", 1)], NO_VARIABLES)
    spans = S.find_spans(F.col("text"), r"(?<=y )[A-Z][a-z]+", "name", "name", 2)
    masked, after = mask_in_order(docs, known, spans)
    # Found as a detector's span, Eves is longer than the variable and its genitive.
    assert {r.doc_order: r.text for r in masked.collect()} == {2: "NAME2 y NAME1", 5: "x NAME2, y NAME3"}
    assert {(r.project_id, r.value): r.token for r in after.collect()} == {("p", "Eve"): "NAME2", ("r", "Kim"): "NAME9", ("p", "Kim"): "NAME1", ("p", "Eves"): "NAME3"}
    assert mask_in_order(docs.limit(0), known, spans)[0].count() == 0
