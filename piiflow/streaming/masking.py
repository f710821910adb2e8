"""Masking a stream of documents: placeholders persist from batch to batch, and a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from piiflow.operators.detectors import pattern_spans
from piiflow.plans.masking import mask_corpus

VARIABLES = "project_id string, value string, token string, kind string, variable_order bigint, batch bigint"


class StreamingMasker:
    """docs(project_id, doc_id, text) in; masked documents and variables in tables under path.

    The state is a table with a part for each batch. A batch reads the parts before its own and overwrites
    its own, so running it again gives the same tokens.
    """

    def __init__(self, path: str, style: str = "kindNumber", detectors: tuple[str, ...] = ("email", "pin", "org", "postal", "phone")):
        self.path, self.style, self.detectors = path, style, detectors

    def variables(self, spark, before: int | None = None) -> DataFrame:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/variables")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], VARIABLES)
        rows = spark.read.schema(VARIABLES).parquet(f"{self.path}/variables")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def batch(self, docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        known = self.variables(spark, number).drop("batch")
        masked, after = mask_corpus(docs, known, pattern_spans(F.col("text"), self.detectors), self.style)
        new = after.join(known.select("project_id", "value"), ["project_id", "value"], "left_anti")
        write = lambda df, name: df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")
        write(new, "variables")
        write(masked.select("project_id", "doc_id", "text", "n_replaced"), "masked")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
