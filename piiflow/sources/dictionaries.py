"""Dictionaries of names and places from counted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_BEARERS = 100
TOP_PLACES = 300
# Endings that make a word a surname, whatever else it means.
SHAPED = ("sson", "son", "berg", "ström", "lund", "gren", "qvist", "kvist", "quist", "man", "dahl", "holm", "stedt", "feldt", "vall", "hammar", "bäck", "blad", "löv", "sjö", "mark", "borg")


def parse_counts(lines: DataFrame) -> DataFrame:
    """lines(value) of "name,count" as name and bearers, parted at the last comma; others are left out."""
    name = F.trim(F.regexp_extract("value", r"^(.*),[^,]*$", 1))
    count = F.trim(F.regexp_extract("value", r",([^,]*)$", 1)).try_cast("long")
    return lines.select(name.alias("name"), count.alias("bearers")).filter((F.col("name") != "") & F.col("bearers").isNotNull())


def title_case(name: Column) -> Column:
    """A capital at the start of each part between blanks and hyphens."""
    part = lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")), " ")


def single_word(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^\p{L}+(?:-\p{L}+)?\z"))


def _wordlike(names: DataFrame, words: DataFrame) -> DataFrame:
    known = words.select(F.lower("word").alias("_w")).distinct().withColumn("_is", F.lit(True))
    return names.join(known, F.lower(names["name"]) == known["_w"], "left").withColumn("wordlike", F.coalesce("_is", F.lit(False))).drop("_w", "_is")


def build(given: DataFrame, surnames: DataFrame, places: DataFrame, words: DataFrame, min_bearers: int = MIN_BEARERS, top: int = TOP_PLACES) -> DataFrame:
    """dictionary(term, class) from given and surnames(name, bearers), places(name, place_rank) and words(word).

    Names need min_bearers and one word. Those that are words too go to a class of their own, but not
    surnames that end like one; a word-like place is kept among the top ones only.
    """
    enough = lambda df: _wordlike(df.groupBy("name").agg(F.max("bearers").alias("bearers")).filter((F.col("bearers") >= min_bearers) & single_word(F.col("name"))), words)
    g = enough(given).select(F.col("name").alias("term"), F.when(F.col("wordlike"), "given_wordlike").otherwise("given").alias("class"))
    shaped = F.rlike(F.lower("name"), F.lit(rf"^.{{3,}}(?:{'|'.join(SHAPED)})\z"))
    s = enough(surnames).select(F.col("name").alias("term"), F.when(F.col("wordlike") & ~shaped, "surname_wordlike").otherwise("surname").alias("class"))
    first = Window.partitionBy("name").orderBy("place_rank")
    p = places.withColumn("name", title_case(F.trim("name"))).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    p = _wordlike(p, words).filter(~F.col("wordlike") | (F.col("place_rank") <= top))
    p = p.select(F.col("name").alias("term"), F.when(F.col("wordlike"), "locality_wordlike").otherwise("locality").alias("class"))
    return g.unionByName(s).unionByName(p)
