"""Counts over detections: an addition of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(detections: DataFrame, *by: str) -> DataFrame:
    """How many detections, documents and values there are by each prefix of the columns."""
    return detections.rollup(*by).agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("value").alias("n_values")
    )


def top_values(detections: DataFrame, k: int) -> DataFrame:
    """The k most frequent values; of ties the first in code point order."""
    return detections.groupBy("kind", "value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value", "kind").limit(k)


def kinds_together(detections: DataFrame) -> DataFrame:
    """In how many documents two kinds stand together. A document gives its kinds once each, of which there are few."""
    kinds = detections.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("_k"))
    pairs = F.flatten(F.transform("_k", lambda a: F.transform(F.filter("_k", lambda b: b > a), lambda b: F.struct(a.alias("kind_a"), b.alias("kind_b")))))
    return kinds.select(F.inline(pairs)).groupBy("kind_a", "kind_b").agg(F.count("*").alias("n_docs"))


def per_window(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """events(ts, kind) counted in windows; on a stream a window closes when it can't change any more."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "kind", "n")
