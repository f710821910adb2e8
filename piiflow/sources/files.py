"""Files as documents: routing by name and type, text, packages, and a status for each file."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piiflow.functions.text import file_extension, normalize_newlines
from piiflow.sources import docx

# The extensions that are read.
MARKDOWN = (".md", ".markdown")
TEXT = (".txt", ".md", ".markdown", ".csv", ".tsv", ".json", ".log", ".xml", ".html", ".htm", ".eml")
WORD = (".docx", ".docm", ".dotx")
LEGACY_WORD = (".doc", ".dot")
WORD_TYPES = (
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-word.document.macroenabled.12",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.template",
)


def file_format(name: Column, mime: Column) -> Column:
    """pdf, docx, legacy, text or unsupported: the first that fits by type or extension."""
    extension, kind = file_extension(name), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when((kind == "application/pdf") | (extension == ".pdf"), "pdf")
        .when(kind.isin(*WORD_TYPES) | extension.isin(*WORD), "docx")
        .when((kind == "application/msword") | extension.isin(*LEGACY_WORD), "legacy")
        .when(kind.startswith("text/") | extension.isin(*TEXT), "text")
        .otherwise("unsupported")
    )


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A folder's files as name, content and mime (null)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.lit(None).cast("string").alias("mime"))


def intake(files: DataFrame) -> DataFrame:
    """files(name, content, mime) as name, format, markdown, text and status.

    status: ok, empty (only white space), legacy, unsupported, pdf (its positioned runs come from elsewhere)
    or failed. A file that fails is a row, and stops none of the others.
    """
    files = files.withColumn("format", file_format(F.col("name"), F.col("mime")))
    text = files.filter("format = 'text'").select("name", "format", F.lower("name").rlike(r"\.(md|markdown)$").alias("markdown"), normalize_newlines(F.col("content").cast("string")).alias("text"))
    text = text.withColumn("status", F.when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty").otherwise("ok"))
    word = docx.extract(files.filter("format = 'docx'").select("name", "content")).select("name", F.lit("docx").alias("format"), F.lit(True).alias("markdown"), "text", "status")
    other = files.filter("format IN ('pdf', 'legacy', 'unsupported')").select("name", "format", F.lit(False).alias("markdown"), F.lit(None).cast("string").alias("text"), F.col("format").alias("status"))
    return text.unionByName(word).unionByName(other)


def pasted(texts: DataFrame, title: str = "Untitled") -> DataFrame:
    """Pasted texts(name, text) that aren't blank, with a name."""
    kept = texts.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return kept.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit(title)))


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for name, content in zip(frame["name"], frame["content"]):
            try:
                with zipfile.ZipFile(BytesIO(content)) as package:
                    rows += [(name, e.filename, e.compress_type, e.file_size, None) for e in package.infolist()]
            except (zipfile.BadZipFile, ValueError, EOFError) as e:
                rows.append((name, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["name", "entry", "method", "size", "error"]).astype({"method": "Int64", "size": "Int64"})


def zip_entries(files: DataFrame) -> DataFrame:
    """The directory of each package: a row for each entry, or one with the error."""
    return files.select("name", "content").mapInPandas(_entries, "name string, entry string, method long, size long, error string")
