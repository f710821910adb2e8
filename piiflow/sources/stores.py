"""Where documents, variables and workspaces are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piiflow.functions.text import safe_stem
from piiflow.operators.catalog import last_writes, parse_stored


def save_workspaces(stored: DataFrame, path: str) -> None:
    """stored(workspace, body, version): a file set for each workspace, each replaced by its last write."""
    writer = last_writes(stored).write.mode("overwrite").partitionBy("workspace").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def load_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """Every workspace with its status; one that can't be read is a row, not an error."""
    return parse_stored(spark.read.parquet(path).select("workspace", "body"))


def save_markdown(docs: DataFrame, path: str, suffix: str = "") -> None:
    """docs(name, text) as text, a folder for each document named by its safe stem."""
    named = docs.select(F.concat(safe_stem(F.col("name")), F.lit(suffix)).alias("document"), F.col("text").alias("value"))
    named.write.mode("overwrite").partitionBy("document").text(path)


def save_table(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share. One of our own is made on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="piiflow-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/piiflow-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """df as a table in the folder that all executors share."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
