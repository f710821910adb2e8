"""Search in projects, documents and variables: by reading all of them, or through an index of their trigrams.

The index holds, for each three signs that follow each other, the blocks of texts that have them. A query is looked
up by its own trigrams, the blocks that have all of them are read, and their texts are searched as ever: what the index
can't tell apart costs time, never a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.functions.text import compile_pattern, escape
from piiflow.sources.stores import materialize

#: Characters of a part (a folder of the index, sorted in memory by one task, which may get a few of them) and of a block (what a trigram points to).
PART_CHARS, BLOCK_CHARS = 1 << 24, 1 << 16
#: Folders that the trigrams are dealt to: as many as there are parts, but no more than this.
MOST_BUCKETS = 4096
#: Folders whose blocks one task sorts for a bucket.
FOLDERS_A_TASK = 1024
#: Up to so many blocks are named in the scan, so that other folders aren't opened; more are only joined.
LISTED = 10_000
#: What is kept: project_id as text and item as a number, whatever they were.
TEXTS = "project_id string, part int, item long, hit string, text string, _block long, _folder int"
TRIGRAMS = "gram long, _folder int, _block long, _bucket int"
# Capitals with a twin that patterns take for the same letter, and the twins.
_TWINS = {"\u0130": "I", "\u212a": "K", "\u212b": "\u00c5", "\u2126": "\u03a9", "\u03f4": "\u0398", "\u1e9e": "SS"}


def folded(text: str) -> str:
    """text with all forms alike that a search in any case takes for one. A part of the text is a part of what comes out."""
    capitals = text.upper()
    for sign, twin in _TWINS.items():
        capitals = capitals.replace(sign, twin)
    return capitals


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text in any case, each as one number: three signs of 21 bits. None of shorter texts."""
    signs = np.frombuffer(folded(text).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((signs[:-2] << 42) | (signs[1:-1] << 21) | signs[2:])


def _block_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in the order of their blocks. What is held are the distinct trigrams of one block."""

    def told(block: tuple, held: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), block[0], np.int32)), pa.array(np.full(len(grams), block[1], np.int64))], ["gram", "_folder", "_block"])

    last, held = None, []
    for batch in batches:
        for folder, block, text in zip(*(batch[c].to_pylist() for c in ("_folder", "_block", "text"))):
            if held and (folder, block) != last:
                yield told(last, held)
                held = []
            last = (folder, block)
            held.append(trigrams(text))
    if held:
        yield told(last, held)


def searchable(projects: DataFrame, documents: DataFrame, variables: DataFrame) -> DataFrame:
    """project_id, part, item, hit, text: projects(name), documents(name and text) and variables(token = value)."""
    rows = projects.select("project_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("item"), F.lit("project").alias("hit"), F.col("name").alias("text"))
    rows = rows.unionByName(documents.select("project_id", F.lit(1).alias("part"), F.col("doc_id").alias("item"), F.lit("document").alias("hit"), F.concat_ws("\n", "name", "text").alias("text")))
    return rows.unionByName(variables.select("project_id", F.lit(2).alias("part"), F.col("variable_order").alias("item"), F.lit("variable").alias("hit"), F.concat("token", F.lit(" = "), "value").alias("text")))


def asked_pattern(spark: SparkSession, query: str) -> str | None:
    """The pattern that a query asks for; None if it is blank, or a pattern that is none."""
    asked = query.strip()
    if len(asked) > 1 and asked[0] == asked[-1] == "/":
        return compile_pattern(spark, asked[1:-1], "i")
    return "(?iu)" + escape(asked) if asked else None


def clip(text: Column, at: Column, width: int = 80) -> Column:
    """About width characters of a text around a place (from 1), on one line."""
    begin = F.greatest(at.cast("int") - width // 4, F.lit(1))
    return F.trim(F.regexp_replace(F.substr(text, begin, F.lit(width)), r"\s+", " "))


def hits(rows: DataFrame, pattern: str | None) -> DataFrame:
    """project_id, hit, item, clip and n_matches of the rows that a pattern finds."""
    if not pattern:
        return rows.limit(0).select("project_id", "hit", "item", F.lit("").alias("clip"), F.lit(0).cast("long").alias("n_matches"))
    rows = rows.filter(F.rlike("text", F.lit(pattern)))
    at = F.length(F.get(F.split("text", pattern, 2), 0)) + 1
    return rows.select("project_id", "hit", "item", clip(F.col("text"), at).alias("clip"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("n_matches"))


def search(projects: DataFrame, documents: DataFrame, variables: DataFrame, query: str) -> DataFrame:
    """Hits of a query in project names, documents (name and text) and variables (token = value).

    A query is part of a text in any case; /.../ is a pattern in any case. A blank query, and a pattern that
    is none, find nothing. Hits come by project, then its documents, then its variables.
    """
    return hits(searchable(projects, documents, variables), asked_pattern(projects.sparkSession, query))


def write_index(rows: DataFrame, path: str, part_chars: int = PART_CHARS, block_chars: int = BLOCK_CHARS) -> None:
    """The rows of searchable() at path: the texts by parts and blocks, and the blocks that have each trigram.

    Rows are dealt to parts by turns, whatever their keys, so copies of one row spread. A block is what lies within block_chars of a part, and a text
    that is longer ends one. Trigrams are made distinct in each block before they are shuffled: the table of
    them grows with the blocks and their vocabulary, not with the words of the texts. It has a row for each trigram of each block, sorted by
    trigram, so a trigram's rows lie together.
    """
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, (rows.agg(F.sum(chars)).first()[0] or 0) // part_chars + 1)
    kept = rows.select(F.col("project_id").cast("string"), "part", F.col("item").cast("long"), "hit", "text")
    dealt = kept.withColumn("_id", F.monotonically_increasing_id()).withColumn("_folder", F.pmod("_id", F.lit(parts)).cast("int"))
    order = Window.partitionBy("_folder").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(chars).over(order), F.lit(0).cast("long"))
    blocks = dealt.repartition(parts, "_folder").withColumn("_block", F.floor(before / block_chars)).drop("_id")
    blocks.write.mode("overwrite").partitionBy("_folder").parquet(f"{path}/texts")

    texts = rows.sparkSession.read.schema(TEXTS).parquet(f"{path}/texts")
    buckets = min(parts, MOST_BUCKETS)
    grams = texts.filter("text IS NOT NULL").select("_folder", "_block", "text").mapInArrow(_block_trigrams, "gram long, _folder int, _block long")
    # A trigram that nearly all blocks have is dealt to more tasks as the folders become more.
    dealt_grams = grams.withColumn("_bucket", _bucket(buckets)).repartition(parts, "_bucket", F.floor(F.col("_folder") / FOLDERS_A_TASK))
    dealt_grams.sortWithinPartitions("_bucket", "gram").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/trigrams")
    rows.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/shape")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The texts of the blocks that have all trigrams of a query; all texts where it has none."""
    texts = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    asked = query.strip()
    grams = trigrams(asked).tolist()
    if not grams or (len(asked) > 1 and asked[0] == asked[-1] == "/"):
        return texts
    of = spark.read.schema("buckets int").parquet(f"{path}/shape").first()[0]
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram long").select(_bucket(of)).distinct().collect()]
    found = spark.read.schema(TRIGRAMS).parquet(f"{path}/trigrams").filter(F.col("_bucket").isin(buckets) & F.col("gram").isin(grams))
    shared = found.groupBy("_folder", "_block").agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(grams))
    shared = materialize(shared.drop("_n"))
    few = shared.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        texts = texts.filter(F.col("_folder").isin(sorted({r["_folder"] for r in few})) & F.col("_block").isin(sorted({r["_block"] for r in few})))
    return texts.join(shared, ["_folder", "_block"], "left_semi")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """search() through the index at path: the same hits. Patterns, and queries under three signs, read all texts."""
    pattern = asked_pattern(spark, query)
    rows = candidates(spark, path, query) if pattern else spark.read.schema(TEXTS).parquet(f"{path}/texts")
    return hits(rows.drop("_folder", "_block"), pattern)
