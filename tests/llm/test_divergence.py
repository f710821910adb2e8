import random
import re
from collections import Counter

import pytest

from piiflow.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, min_docs, top):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOW))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        seen = Counter(t for la, _, terms in rows if la == lang for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= min_docs)
        count = {s: Counter(t for la, so, terms in rows if (la, so) == (lang, s) for t in terms) for s in {r[1] for r in rows if r[0] == lang}}
        whole = sum(count.values(), Counter())

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = p(whole)
        ps = {s: p(c) for s, c in count.items()}
        for s in count:
            pairs = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(ps[s][t] - q[t], t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


SCHEMA = "lang string, source string, text string"


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_sums(spark, seed):
    rng = random.Random(seed)
    words = ["The", "THE", "x", "été", "漢字", "don't", "a_b", "Z9z", "\U0001f600", "ÅNGA"] + [f"w{chr(97 + k)}" for k in range(20)]
    draw = lambda: " ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(rng.randrange(30)))
    rows = [(rng.choice(["en", "en", "sv", None]), rng.choice(["a", "b", "B", "ö", "", None]), rng.choice([None, "", "12 !", draw(), draw(), draw()])) for _ in range(150)]
    rows += [("xx", "one", "once"), ("xx", "two", None), ("yy", "alone", "word " * 9)] + rows[:20]
    got = sorted(map(tuple, D.divergence(spark.createDataFrame(rows, SCHEMA), 5, 7).collect()))
    assert got == plainly(rows, 5, 7)


def test_long_texts_many_terms_and_clashing_columns(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = " ".join(a + b + c for a in letters for b in letters for c in letters)
    rows = [("en", s, many * k) for s, k in (("a", 1), ("b", 2), ("b", 2), ("c", 1))] + [("en", "d", "zzz " * 300_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS term", "2 AS docs", "3 AS value", "'y' AS item", "4 AS rank")
    got = sorted(map(tuple, D.divergence(docs, 2, 5).collect()))
    assert got == plainly(rows, 2, 5)


def test_empty_tables_and_large_counts(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.range(1).selectExpr("9000000000000L AS n", "27000000000000L AS total", "7L AS v")
    from pyspark.sql import functions as F

    assert df.select(D._p(F.col("n"), F.col("total"), F.col("v")).alias("p")).first().p == 1 + 1_000_000_000 * 9_000_000_000_005 // (27_000_000_000_000 + 35)
