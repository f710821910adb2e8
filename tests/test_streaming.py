"""Numbers in keyed state: the same tokens as a batch run, whatever comes again or late."""

from pyspark.sql import functions as F

from piiflow.operators.detectors import pattern_spans
from piiflow.plans.masking import mask_corpus
from piiflow.streaming.keyed import KeyedMasker

SCHEMA = "project_id string, doc_id long, ts timestamp, text string"
BATCHES = [
    [("p", 1, "10:00", "a@x.se och b@x.se"), ("p", 2, "10:01", "b@x.se, 811218-9876"), ("q", 1, "10:00", "c@x.se"), (None, 9, "10:00", "d@x.se"), ("p", 8, "10:00", None)],
    [("p", 1, "10:00", "a@x.se och b@x.se"), ("p", 3, "10:30", "e@x.se a@x.se"), ("q", 2, "10:10", "a@x.se c@x.se")],
    [("p", 4, "13:00", "f@x.se")],
    [("p", 5, "09:00", "late@x.se"), ("p", 6, "13:05", "f@x.se, g@x.se, 811218-9876"), ("p", 4, "13:00", "f@x.se")],
]


def test_batches_with_copies_and_late_rows(spark, tmp_path):
    rows = [[(p, d, f"2024-01-01 {t}:00", x) for p, d, t, x in b] for b in BATCHES]
    frame = lambda b: spark.createDataFrame(b, "project_id string, doc_id long, t string, text string").select("project_id", "doc_id", F.to_timestamp("t").alias("ts"), "text").coalesce(1)
    masker = KeyedMasker(detectors=("email", "pin"))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for batch in rows:
        frame(batch).write.mode("append").parquet(source)
        # A run for each batch: what is known comes from the checkpoint.
        query = masker.start(spark.readStream.schema(SCHEMA).parquet(source), out, check)
        query.awaitTermination(120)
        assert query.exception() is None
    got = {(r.project_id, r.doc_id): (r.text, r.n_replaced) for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count() == 9
    # One run over what came in time, each document once.
    seen, docs = set(), []
    for row in (r for b in rows for r in b):
        if row[:2] not in seen and row[1] != 5 and row[0] is not None:
            seen.add(row[:2])
            docs.append((row[0], row[1], row[3]))
    batch = spark.createDataFrame(docs, "project_id string, doc_id long, text string")
    none = spark.createDataFrame([], "project_id string, value string, token string, kind string, variable_order long")
    masked, after = mask_corpus(batch, none, pattern_spans(F.col("text"), ("email", "pin")))
    assert {k: v for k, v in got.items() if k[0]} == {(r.project_id, r.doc_id): (r.text, r.n_replaced) for r in masked.collect()}
    assert got[None, 9] == ("d@x.se", 0) and ("p", 5) not in got
    added = spark.read.parquet(out).select("project_id", F.inline("added")).collect()
    assert sorted((r.project_id, r.value, r.token) for r in added) == sorted((r.project_id, r.value, r.token) for r in after.collect())


def test_counters_that_read_alike():
    from piiflow.streaming.keyed import Numbers

    class Map(dict):
        getValue, containsKey, updateValue = dict.get, dict.__contains__, dict.__setitem__

    numbers = Numbers(True)
    numbers.numbers, numbers.last, numbers.taken = Map(), Map(), Map()
    forms = [f"{c}{numbers._number(f'{c}v{k}', c, c)[0]}" for k in range(30) for c in ("A", "A1", "A11")]
    assert len(set(forms)) == len(forms) == 90
    assert numbers._number("Av3", "A", "A") == (4, "A", False)
