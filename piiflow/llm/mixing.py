"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of a token budget by its weight, at most a given number of times its size.
A source's complete epochs come first: every document is taken whole as often as the target holds the
source's size. What is left of the target selects documents by exponential keys, -ln(u) / weight, in
ascending order, and sums their sizes up to the rest of the budget; the document at the edge gives the
words that are still missing. u comes from a digest of the identifier, so a rerun takes the same words.

The order within a source is cut into ranges of the key. Sums of the ranges say how much lies before
each of them, so no task sorts a whole source, however large one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.llm.common import WORD, spread, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
ROWS_IN_RANGE = 4_000
COPIES_IN_BLOCK = 10_000


def size_of(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) with the double target.

    Sources in code point order, null last, weigh as weights repeat. A source whose share exceeds most
    times its size stops there, and the excess is shared anew by weight. That ends at one level for all
    others, target = weight * level: taking sources by most * size / weight, the first whose bound lies
    at or above the level of the rest fixes it; of all that do so, that level is the highest. The table has a row for each source, not each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("bound", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    df = df.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.coalesce(F.sum("bound").over(before), F.lit(0.0)).alias("_bounded"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_open"),
    )
    level = (budget * F.col("_all") - F.col("_bounded")) / F.col("_open")
    df = df.withColumn("_level", F.when(level <= F.col("bound") / F.col("weight"), level))
    df = df.withColumn("_level", F.max("_level").over(everything))
    level = F.coalesce(F.col("weight") * F.col("_level"), F.col("bound"))
    return df.withColumn("target", F.least(F.col("bound"), level)).select("source", "source_size", "target")


def uniform(identifier: Column, seed: str) -> Column:
    """Between 0 and 1, from a digest: the same on each run and each machine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), identifier.cast("string"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weight: Column | None = None, seed: str = "mix", carried: tuple[str, ...] = (), **shares) -> DataFrame:
    """docs(doc_id, source, size) with source_size, target and taken, and the columns carried.

    weight: a document's quality weight, above 0. Sizes of 0 take nothing; with only such documents all
    targets are 0. Rows that repeat an identifier are documents of their own, in order of size and of the
    columns carried; rows without one get their key from what is carried, or share one. An empty table gives an empty result. No row exceeds ceil(target / source_size) times its size.
    """
    weight = F.lit(1.0) if weight is None else weight
    docs = docs.select("doc_id", "source", "size", *carried, F.greatest(weight.cast("double"), F.lit(1e-6)).alias("_weight"))
    # Equal rows go through the order as one, with their number, so that none of their ranges is hot.
    docs = docs.groupBy(*docs.columns).agg(F.count("*").alias("_copies"))
    identifier = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", *carried)) if carried else F.col("doc_id")
    docs = written(docs.withColumns({"_key": -F.ln(uniform(identifier, seed)) / F.col("_weight"), "_sizes": F.col("size") * F.col("_copies")}))
    by_source = docs.groupBy("source").agg(F.sum("_sizes").alias("source_size"), F.min("_weight").alias("_least"), F.sum(F.col("_weight") * F.col("_copies")).alias("_weights"))
    goals = targets(by_source.select("source", "source_size"), **shares)
    goals = goals.withColumnRenamed("source", "_of").join(by_source.select("source", "_least", "_weights"), F.col("_of").eqNullSafe(F.col("source"))).drop("_of")
    goals = goals.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("_rest", F.round(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size"))
    # Ranges are even for documents of the source's least weight. One of weight w is w / least times as dense in the first
    # range, where most lie, so that many more ranges keep ROWS_IN_RANGE there; the sums of ranges make any of them exact.
    goals = written(goals.withColumn("_ranges", F.ceil(F.col("_weights") / F.col("_least") / ROWS_IN_RANGE)))
    goals = goals.withColumnRenamed("source", "_of")
    docs = docs.join(goals, docs["source"].eqNullSafe(goals["_of"])).drop("_of")
    docs = docs.withColumn("_range", F.floor(-F.expm1(-F.col("_least") * F.col("_key")) * F.col("_ranges")).cast("long"))
    sums = docs.groupBy("source", "_range").agg(F.sum("_sizes").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    docs = docs.join(sums, docs["source"].eqNullSafe(sums["_of"]) & (docs["_range"] == sums["_at"]))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_sizes").over(inside), F.lit(0)))
    # The copies of a row one by one, in blocks, so that no array is as long as a group of copies.
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k))
    docs = docs.withColumn("_block", upto(F.floor((F.col("_copies") - 1) / COPIES_IN_BLOCK)))
    docs = docs.withColumn("_copy", upto(F.least(F.lit(COPIES_IN_BLOCK), F.col("_copies") - F.col("_block") * COPIES_IN_BLOCK) - 1))
    before = F.col("_before") + (F.col("_block") * COPIES_IN_BLOCK + F.col("_copy")) * F.col("size")
    selected = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - before))
    return docs.select("doc_id", "source", "size", *carried, "source_size", "target", (F.col("_epochs") * F.col("size") + selected).cast("long").alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality) as weights: 2 for good, 0.5 for bad, the best of repeated rows."""
    return labels.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max(F.when(F.col("quality") > 0, 2.0).otherwise(0.5)).alias("_quality"))


def weighed(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """mix() of docs(doc_id, source, size), with weights from labels and 1 for documents without any."""
    weights = quality_weights(labels)
    docs = docs.join(weights, docs["doc_id"] == weights["_labelled"], "left")
    return mix(docs, F.coalesce(F.col("_quality"), F.lit(1.0)), carried=carried)


def take(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, source, text, ...) of which weighed() takes words, with size, source_size, target and taken.

    Rows that repeat doc_id, source and text share what is taken of all of them evenly, to the word. Columns of
    docs that clash with one of the new names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken")])
    row = (F.col("source").isNull(), "source", F.col("text").isNull(), "text")
    keyed = docs.withColumns({"_a": F.xxhash64("doc_id", *row), "_b": F.xxhash64(F.lit(1), "doc_id", *row)})
    sizes = keyed.select("doc_id", "source", "_a", "_b", size_of(F.col("text")).alias("size"))
    taken = weighed(sizes, labels, ("_a", "_b")).groupBy("_a", "_b").agg(
        F.min("size").alias("size"), F.min("source_size").alias("source_size"), F.min("target").alias("target"), F.sum("taken").alias("_taken"), F.count("*").alias("_rows")
    )
    # Only documents of which something is taken stay; the number of a row among its repeats says its share.
    order = Window.partitionBy("_a", "_b").orderBy(F.xxhash64(*docs.columns))
    upto = lambda k: F.expr(f"_taken * {k} div _rows")
    joined = keyed.join(taken.filter("_taken > 0"), ["_a", "_b"]).withColumn("_k", F.row_number().over(order).cast("long"))
    return joined.withColumn("taken", upto("_k") - upto("(_k - 1)")).filter("taken > 0").select(*docs.columns, "size", "source_size", "target", "taken")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the words that the mix takes of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    sizes = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return weighed(sizes, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS weight,
    2.0::DOUBLE * source_size::DOUBLE AS bound FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(bound) OVER before, 0)) /
      (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighted WINDOW before AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(bound, coalesce(weight * max(CASE WHEN level <= bound / weight THEN level END) OVER (), bound)) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals
), weights AS (
  SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id
), keyed AS (
  SELECT s.doc_id, s.size, p.source, p.source_size, p.target, p.epochs, round(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    -ln((('0x' || substr(md5(concat_ws(':', 'mix', s.doc_id::VARCHAR)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / coalesce(w.weight, 1) AS key
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN weights w ON s.doc_id = w.doc_id
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - coalesce(sum(size) OVER (
  PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken FROM keyed
"""
