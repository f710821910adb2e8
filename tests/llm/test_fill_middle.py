import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiflow.llm import fill_middle as M

ALPHABETS = ["ab", "aé", "漢字", "a\U0001f600é漢\x00\n"]


@pytest.mark.parametrize("seed", range(12))
def test_rank_and_select_against_code_points(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(ALPHABETS[seed % 4]) for _ in range(rng.choice([0, 1, 7, 8, 511, 512, 513, 5000])))
    data = text.encode()
    bits = M.Boundaries(np.frombuffer(data, "u1"))
    starts = [k for k, b in enumerate(data) if b & 0xC0 != 0x80]
    assert bits.total == len(text)
    assert bits.select(np.arange(len(text) + 1)).tolist() == [*starts, len(data)]
    at = np.arange(len(data) + 1)
    assert bits.rank(at).tolist() == [sum(s < k for s in starts) for k in at] if len(data) < 3000 else True


def plainly(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_outputs_and_round_trip_against_plain_cuts(spark):
    rng = random.Random(5)
    texts = ["", None, "x", "<P>", "a<S>b", "é<M", "<<<<<S<P<M", "\U0001f600" * 3, "漢" * 70_000, "long " * 400_000, "\n", "\x00"]
    texts += ["".join(rng.choice("ab<>PSM é漢\U0001f600\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(k * 37 - 5, t) for k, t in enumerate(texts)] + [(None, "no number"), (None, None), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit(3), "form": F.lit("psm"), "n": F.lit("x")})
    got = M.transform(docs).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plainly(i, t), t or "") for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_shares_and_runs(spark, monkeypatch):
    rows = [(k, "abcdefé" * (k % 5 + 1)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forms = {r.form: r["count"] for r in M.transform(docs).groupBy("form").count().collect()}
    assert 300 < forms["plain"] < 500 and 550 < forms["spm"] < 880
    assert M.transform(docs, plain_percent=100).filter("form <> 'plain'").isEmpty()
    assert M.transform(docs.limit(0)).count() == 0
