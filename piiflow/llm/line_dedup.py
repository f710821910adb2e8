"""Line dedup: lines that many documents share stay in one of them only.

Normalised lines are exploded and hashed to 128 bits, the distinct documents of each hash counted, lines
over the threshold dropped but for the last document that holds them, and the rest put together by
position. Only hashes and positions are shuffled by line, the texts once by document. Counting
first reduces (hash, document), then (hash), so a line that a third of all documents hold reaches its
task as one partial count from each of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import spread, written

MIN_CHARS = 20
MIN_DOCS = 3
#: So many shared lines, those in most documents, are sent to all tasks, so that no task gets all rows of a common line.
SENT_LINES = 50_000
_LINES = "row long, doc_id long, pos int, h1 long, h2 long"


def _hashed(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        # Continuation bytes of UTF-8 don't count as characters.
        keep = bytes(range(0x80, 0xC0))
        for batch in batches:
            rows, docs, positions, digests = [], [], [], []

            def table() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(positions, pa.int32()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                    ["row", "doc_id", "pos", "h1", "h2"],
                )

            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                if not text.is_valid or not doc.is_valid:
                    continue
                row, doc = row.as_py(), doc.as_py()
                for pos, line in enumerate(text.as_py().encode().split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(b" \t\n\r\x0b\f").lower()  # bytes.lower() changes A-Z only
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, keep)) >= min_chars):
                        rows.append(row)
                        docs.append(doc)
                        positions.append(pos)
                        digests.append(xxhash.xxh3_128_digest(key))
                if len(rows) > 50_000:
                    yield table()
                    rows, docs, positions, digests = [], [], [], []
            if rows:
                yield table()

    return lines


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text, ...) with text rewritten, and the new columns n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of min_chars or
    more code points, in min_docs documents or more, lose all their lines except in the largest doc_id
    that holds them. A null text is one empty line and becomes an empty text. Documents without a doc_id
    keep all their lines and hold none. Rows that repeat a doc_id belong to one document when documents
    are counted, and each row is rewritten by itself. An empty table gives an empty result; n_lines and
    n_dropped replace columns of such names, and all other columns come back as they were, whatever they are called.
    """
    docs = docs.drop("n_lines", "n_dropped")
    # The caller's columns travel in a struct, so that none can clash. A row is named by the hash of what it holds: a recomputed task gives the same.
    others = F.struct(*[F.col(c) for c in docs.columns if c.lower() != "text"]).alias("others")
    keyed = docs.select(others, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").alias("text"))
    lines = written(keyed.select("row", "doc_id", "text").mapInArrow(_hashed(min_chars), _LINES))
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    shared = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    shared = written(shared)
    line = ["h1", "h2"]
    common = F.broadcast(shared.orderBy(F.desc("n"), *line).limit(SENT_LINES))  # bounded by its limit
    rare = shared.join(common.select(*line), line, "left_anti")
    found = lines.join(common, line).unionByName(lines.join(common.select(*line), line, "left_anti").join(rare, line))
    dropped = found.filter(F.col("doc_id") != F.col("keeper")).groupBy("row", "doc_id").agg(F.collect_set("pos").alias("dropped"))
    split = keyed.select("others", "doc_id", "row", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")).join(dropped, ["doc_id", "row"], "left")
    # The joined array is a plain column, so each position is looked up in constant time.
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = split.select("others", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.greatest(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    own = [F.col("text").alias(c) if c.lower() == "text" else F.col("others")[c].alias(c) for c in docs.columns]
    return out.select(*own, "n_lines", "n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what is left of every document, as a digest."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> s.keeper, false) AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
