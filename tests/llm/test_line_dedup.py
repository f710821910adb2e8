import random

import pytest

from piiflow.llm import line_dedup

BLANK = " \t\n\r\x0b\x0c"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least=20, docs=3):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(LOW)
            if doc is not None and len(key) >= least:
                held.setdefault(key, set()).add(doc)
    last = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or last.get(x.strip(BLANK).translate(LOW), doc) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [0, 2, 50_000])
def test_common_and_rare_lines_against_plain_counts(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SENT_LINES", sent)
    rng = random.Random(sent)
    lines = [f"line number {k} of a text that many share" for k in range(12)] + ["short", "", " \t", "é" * 19, "É" * 20, "x" * 40_000]
    draw = lambda: "\n".join(rng.choice(["", "  ", "\t"]) + (lambda x: x.upper() if rng.random() < 0.2 else x)(rng.choice(lines)) for _ in range(rng.randrange(9)))
    rows = [(k, draw()) for k in range(150)] + [(None, draw()), (None, draw()), (7, draw()), (8, None), (9, lines[0]), (9, lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_shared_lines(docs).collect()]
    assert sorted(got, key=repr) == plainly(rows)


def test_columns_of_the_caller_come_back(spark):
    docs = spark.createDataFrame([(k, "a line that three documents have\nown") for k in range(3)], "doc_id int, text string")
    names = ("_row", "_lines", "row", "lines", "dropped", "others", "keeper", "h1", "pos", "n", "_dropped")
    docs = docs.selectExpr("'front' AS front", "*", *[f"concat('{n}', doc_id) AS {n}" for n in names], "5 AS n_lines")
    got = line_dedup.drop_shared_lines(docs).orderBy("doc_id").collect()
    assert got[0].__fields__ == ["front", "doc_id", "text", *names, "n_lines", "n_dropped"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names) and [r.text for r in got] == ["own", "own", "a line that three documents have\nown"]
    assert docs.schema["doc_id"].dataType == line_dedup.drop_shared_lines(docs).schema["doc_id"].dataType
