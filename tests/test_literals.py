"""Literals, places and numbers against plain versions, in both ways that each can go."""

import random
import time

import pytest
from pyspark.sql import functions as F

from piiflow.functions import placeholders
from piiflow.operators import detectors as D, literals as L, spans as S, tokens

WORDS = ["Anna", "Ek", "ek", "Annas", "AB", "42", "_x", "(", "é", "Ek's", "ss", "漢字", "\U0001f600"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", "", ", ", "s ", "-", "\n"]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def plain_replace(text, pairs, suffixes):
    """Every occurrence by trying each start, then the longest first."""
    word = lambda c: c.isalnum() or c == "_"
    hits = []
    for v in pairs:
        for at in range(len(text) - len(v) + 1):
            if not text.startswith(v, at):
                continue
            end = at + len(v)
            left = not (word(v[0]) and at and word(text[at - 1]))
            right = not word(v[-1]) or any(text.startswith(s, end) and not word(text[end + len(s) : end + len(s) + 1] or " ") for s in ("", *suffixes))
            if left and right:
                hits.append((at, end, v))
    kept = []
    for at, end, v in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if all(end <= a or b <= at for a, b, _ in kept):
            kept.append((at, end, v))
    out, upto = "", 0
    for at, end, v in sorted(kept):
        out, upto = out + text[upto:at] + pairs[v], end
    return out + text[upto:], len(kept)


@pytest.mark.parametrize("sent", [True, False])
def test_replacing_for_each_project(spark, monkeypatch, sent):
    monkeypatch.setattr(L, "SENT_ROWS", 100_000 if sent else 0)
    rows = [(("p", "q", None)[k % 3], k, t) for k, t in enumerate(texts(120, 3))] + [("p", 900, None), ("q", 901, "")]
    docs = spark.createDataFrame(rows, "project_id string, doc_id long, text string").withColumn("n_replaced", F.lit("clash"))
    of = {"p": {"Anna": "N1", "Anna Ek": "N2", "Ek, Ek": "<>", "(": "[", "42": ""}, "q": {"Ek": "漢", "AB 42": "N3", "_x": "N4", "é": "Anna"}}
    pairs = [(p, v, r, 0) for p, x in of.items() for v, r in x.items()] + [("p", "Anna", "late", 7), (None, "Ek", "no", 0), ("p", "", "no", 0), ("p", None, "no", 0), ("q", "ek", None, 0)]
    got = L.replace_literals(docs, spark.createDataFrame(pairs, "project_id string, value string, replacement string, seq int"), on=("project_id",), suffixes=("s",)).collect()
    want = [(p, k, *(plain_replace(t, of[p], ("s",)) if p and t is not None else (t, 0))) for p, k, t in rows]
    assert sorted(((r.project_id, r.doc_id, r.text, r.n_replaced) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[3] for w in want) > 100


def test_inside_of_words_in_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(["aaaa", "xabay", "", None, "a", "ba\U0001f600ab"])), "doc_id long, text string")
    literals = spark.createDataFrame([("aa",), ("a",), ("aba",), ("\U0001f600a",)], "value string")
    found = lambda: sorted((r.doc_id, r.start, r.value) for r in L.find_literals(docs, literals, whole_word=False).collect())
    one = found()
    monkeypatch.setattr(L, "SENT_ROWS", 0)
    assert one == found() and (0, 1, "aa") in one and (0, 2, "aa") in one and (1, 1, "aba") in one and (5, 2, "\U0001f600a") in one


def test_many_literals_cost_one_pass(spark):
    text = " ".join(f"name{k % 5000} och" for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pairs = spark.createDataFrame([(f"name{k}", f"N{k}") for k in range(10_000)], "value string, replacement string")
    began = time.perf_counter()
    row = L.replace_literals(docs, pairs).first()
    assert row.n_replaced == 100_000 and row.text.startswith("N0 och N1 och") and time.perf_counter() - began < 30


@pytest.mark.parametrize("sent", [True, False])
def test_places_against_the_pattern(spark, monkeypatch, sent):
    monkeypatch.setattr(L, "SENT_ROWS", 100_000 if sent else 0)
    rng = random.Random(8)
    parts = ["Stockholm", "Upplands", "Väsby", "Upplands Väsby", "Lund", "Bro", "bor", "i", "3", ",", ";", "s", "_", "x", "A-B", "A", "B"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice([" ", "  ", "", "s ", "\xa0", "-"]) for _ in range(rng.randrange(30)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    safe, wordlike = ["Stockholm", "Upplands Väsby", "Väsby", "A-B", "A"], ["Lund", "Bro", "Upplands", "B"]
    dictionary = spark.createDataFrame([(t, "locality") for t in safe] + [(t, "locality_wordlike") for t in wordlike] + [("bor", "stop")], "term string, class string")
    got = sorted((r.doc_id, r.start, r.end, r.value) for r in D.place_spans(docs, dictionary).collect())
    want = sorted((r.doc_id, r.start, r.end, r.value) for r in S.exploded(docs, D.city_spans(F.col("text"), safe, wordlike)).collect())
    assert got == want and len(got) > 300


def plain_mint(new, taken, style, form):
    """Ranks of each counter over the numbers whose token is free, by listing them."""
    out, used = {}, set(taken)
    numbers = {}
    for value, kind in new:
        counter = (placeholders_counter(kind) if style in ("kindNumber", "bracketKind", "mustache") else "")
        n = numbers.get(counter, 0) + 1
        while form(n, kind) in used:
            n += 1
        numbers[counter] = n
        out[value] = form(n, kind)
    return out


def placeholders_counter(kind):
    return kind.upper()


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("style", placeholders.STYLES)
def test_gaps_are_filled_in_order(spark, monkeypatch, style, few):
    monkeypatch.setattr(tokens, "ONE_WINDOW", 1_000_000 if few else 0)
    rng = random.Random(len(style))

    def letters(n):
        s, n = "", n - 1
        while n or len(s) < 3:
            s, n = chr(65 + n % 26) + s, n // 26
        return s

    form = {
        "upperLetters": lambda n, k: letters(n), "lowerLetters": lambda n, k: letters(n).lower(), "dollarNumber": lambda n, k: f"${n}", "kindNumber": lambda n, k: f"{k.upper()}{n}",
        "bracketKind": lambda n, k: f"[{k.upper()} {n}]", "mustache": lambda n, k: f"{{{{{k.lower()}{n}}}}}",
    }[style]
    kinds = ["name", "city"]
    taken = {form(rng.randrange(1, 60), rng.choice(kinds)) for _ in range(40)} | {"NAME007", "x", "", "[NAME 0]", "$0", "{{name}}", "AAa", "NAME99999999999999999999", form(10**9, "name")}
    new = [(f"v{k:03}", rng.choice(kinds)) for k in range(80)]
    rows = spark.createDataFrame([("p", v, k, i) for i, (v, k) in enumerate(new)] + [("q", "alone", "name", 1)], "project_id string, value string, kind string, mint_order long")
    got = {(r.project_id, r.value): r.token for r in tokens.mint(rows, spark.createDataFrame([("p", t) for t in taken], "project_id string, token string"), style).collect()}
    assert got == {("p", v): t for v, t in plain_mint(new, taken, style, form).items()} | {("q", "alone"): form(1, "name")}


def test_running_by_ranges_and_in_one_window(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k % 3, k, rng.choice([None, rng.randrange(50)])) for k in range(500)], "g int, k int, v long")
    for how in (F.sum, F.max):
        one, two = (sorted(map(tuple, tokens.running(df.fillna(0) if how is F.sum else df, ["g"], ["k"], "r", F.col("v"), how, few).select("g", "k", "r").collect())) for few in (True, False))
        assert one == two


def test_many_literals_are_never_sent_whole(spark, monkeypatch):
    """Files of a few MB hold more literals than a driver can send to all: above the limit of rows they are joined by shuffles."""
    monkeypatch.setattr(L, "SENT_ROWS", 0)
    docs = spark.createDataFrame([(1, "Ek och Anna"), (2, "ingen")], "doc_id int, text string")
    pairs = spark.createDataFrame([("Ek", "A"), ("Anna", "B")], "value string, replacement string")
    for made in (L.find_literals(docs, pairs), L.replace_literals(docs, pairs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
