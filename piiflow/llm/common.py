"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts of the operators define it: blank and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A maximal run of anything else is a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer files than cores out to all cores; others are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. One of our own is made on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="piiflow-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and lost executors cost no work before this point."""
    path = f"{shared_folder(df.sparkSession)}/piiflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def release(table: DataFrame) -> None:
    """Empties what written() wrote for a table that nothing reads any more."""
    table.sparkSession.range(0).write.mode("overwrite").parquet(table._written_at)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once.

    A one-row generator keeps the optimizer from copying these expressions into the lambdas of later
    columns, where they would run anew for each array element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
