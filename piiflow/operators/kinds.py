"""Labels of custom kinds: normal forms, problems, merging, parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.functions.text import SPACE
from piiflow.schema import KINDS

MAX_LABEL = 24
SHAPE = "array<struct<id:string,label:string,createdAt:string>>"


def normalize_label(label: Column) -> Column:
    return F.substr(F.trim(F.regexp_replace(label, SPACE + "+", " ")), F.lit(1), F.lit(MAX_LABEL))


def fold_label(label: Column) -> Column:
    return F.lower(normalize_label(label))


def label_problem(labels: DataFrame, existing: DataFrame) -> DataFrame:
    """labels(label) with problem: empty, unusable, reserved, duplicate, or null."""
    known = existing.select(fold_label(F.col("label")).alias("_known")).distinct()
    df = labels.join(known, fold_label(labels["label"]) == F.col("_known"), "left")
    label = normalize_label(df["label"])
    problem = (
        F.when(label == "", "empty").when(~F.rlike(label, F.lit(r"[\p{L}\p{N}]")), "unusable").when(F.lower(label).isin(*KINDS), "reserved").when(F.col("_known").isNotNull(), "duplicate")
    )
    return df.withColumn("problem", problem).drop("_known")


def merge_kinds(everywhere: DataFrame, workspace: DataFrame) -> DataFrame:
    """Global kinds, then a workspace's; of labels that fold alike the first stays. Both: id, label, kind_order."""
    both = everywhere.withColumn("scope", F.lit("global")).unionByName(workspace.withColumn("scope", F.lit("workspace")))
    first = Window.partitionBy(fold_label(F.col("label"))).orderBy("scope", "kind_order", "id")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def parse_kinds(stored: DataFrame) -> DataFrame:
    """stored(owner, json) as kinds; entries that can't be one are left out, and what can't be read is none."""
    rows = stored.select("owner", F.posexplode_outer(F.from_json("json", SHAPE, {"mode": "PERMISSIVE"})).alias("at", "k"))
    rows = rows.select("owner", "at", F.col("k.id").alias("id"), normalize_label(F.col("k.label")).alias("label"), F.coalesce("k.createdAt", F.lit("1970-01-01T00:00:00.000Z")).alias("created_at"))
    rows = rows.filter((F.length("id") > 0) & (F.length("label") > 0))
    first = Window.partitionBy("owner", F.lower("label")).orderBy("at")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def set_scope(kinds: DataFrame, moves: DataFrame) -> DataFrame:
    """kinds(id, scope, ...) with the scopes of moves(id, scope)."""
    m = moves.select("id", F.col("scope").alias("_scope"))
    return kinds.join(m, "id", "left").withColumn("scope", F.coalesce("_scope", "scope")).drop("_scope")


def rename(kinds: DataFrame, changes: DataFrame) -> DataFrame:
    """kinds(id, label) with changes(id, new_label); a blank or taken label changes nothing."""
    taken = kinds.select(F.col("id").alias("_id"), fold_label(F.col("label")).alias("_fold"))
    c = changes.select("id", normalize_label(F.col("new_label")).alias("_new")).filter("_new <> ''")
    free = c.join(taken, (F.lower(c["_new"]) == taken["_fold"]) & (c["id"] != taken["_id"]), "left_anti")
    return kinds.join(free, "id", "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def options(used: DataFrame) -> DataFrame:
    """The built-in kinds, then each other kind in use(kind, use_order), whatever its case, by its first spelling."""
    spark = used.sparkSession
    built_in = spark.range(len(KINDS)).select(F.get(F.array(*map(F.lit, KINDS)), F.col("id").cast("int")).alias("kind"), (F.col("id") - len(KINDS)).alias("use_order"))
    both = built_in.unionByName(used.select("kind", F.col("use_order").cast("long")))
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("kind")).orderBy("use_order", "kind"))).filter("_n = 1")
    return first.select("kind", F.row_number().over(Window.orderBy("use_order", "kind")).cast("long").alias("option_order"))


def is_built_in(kind: Column) -> Column:
    return F.coalesce(kind.isin(*KINDS), F.lit(False))


def kind_labels(used: DataFrame, labels: DataFrame) -> DataFrame:
    """used(kind) with label and built_in: a label of labels(kind, label), or else the kind as it is."""
    named = labels.groupBy("kind").agg(F.min("label").alias("_label"))
    return used.join(named, "kind", "left").select(*used.columns, F.coalesce("_label", "kind").alias("label"), is_built_in(F.col("kind")).alias("built_in"))
