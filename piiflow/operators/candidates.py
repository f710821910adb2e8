"""From spans to candidates: pool, resolve, filter, group, order; rule listings and reviews."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.functions.text import compile_pattern, matches_empty
from piiflow.operators.literals import find_literals
from piiflow.operators.spans import exploded, find_spans, pool, resolved, values

VARIABLE_PRIORITY, ALWAYS_PRIORITY, PATTERN_PRIORITY = 20, 15, 6
_KEPT_SOURCES = ("variable", "always")


#: Not within a character of two units, where a pattern could match nothing.
_WHOLE = r"(?![\x{DC00}-\x{DFFF}])"


def _usable(spark, rules: Sequence[dict]) -> Iterator[tuple[int, dict, str, bool]]:
    """Place, rule, pattern and whether it can match nothing; disabled and invalid rules are skipped."""
    for k, rule in enumerate(rules):
        if not rule.get("enabled", True):
            continue
        pattern = compile_pattern(spark, rule["pattern"], rule.get("flags") or "")
        if pattern is not None:
            yield k, rule, _WHOLE + f"(?:{pattern})", matches_empty(spark, pattern)


def pattern_rule_spans(spark, text: Column, rules: Sequence[dict]) -> Column:
    """The spans of user patterns; disabled and invalid ones are skipped, and matches of nothing are no hits."""
    return pool(*[find_spans(text, p, rule["kind"], f"pattern:{rule['id']}", PATTERN_PRIORITY, 10 + k, often_empty=empty) for k, rule, p, empty in _usable(spark, rules)])


def pattern_rule_values(spark, text: Column, rules: Sequence[dict]) -> Column:
    """The values of pattern_rule_spans alone, each as often as it is hit: an array of strings."""
    found = [values(text, p, empty) for _, _, p, empty in _usable(spark, rules)]
    return F.concat(*found) if found else F.array().cast("array<string>")


def detect(
    docs: DataFrame, spans: Column, more: Sequence[DataFrame] = (), variables: DataFrame | None = None, always: DataFrame | None = None,
    never: DataFrame | None = None, ignored: DataFrame | None = None, on: Sequence[str] = (), key: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Disjoint spans of docs, one row each: the document's key and the span's fields.

    spans: an array Column of patterns; more: tables of spans with the key. variables and always are literals
    that rank before detectors of equal length. never (any case) and ignored (exact, per on) drop spans
    after overlaps are resolved, and never those of a variable or the always list.
    """
    columns = [*key, *(c for c in on if c not in key)]
    tables = [exploded(docs, spans, columns), *(m.select(*columns, "start", "end", "value", "kind", "source", "priority", "seq") for m in more)]
    for table, source, priority, by in ((variables, "variable", VARIABLE_PRIORITY, on), (always, "always", ALWAYS_PRIORITY, ())):
        if table is not None:
            literals = table.select(*by, "value", "kind", F.lit(source).alias("source"), F.lit(priority).alias("priority"), F.lit(0 if source == "variable" else 1).alias("seq"))
            tables.append(find_literals(docs, literals, by, columns, ("s",)).select(*columns, "start", "end", "value", "kind", "source", "priority", "seq"))
    everything = tables[0]
    for t in tables[1:]:
        everything = everything.unionByName(t)
    found = resolved(everything, columns)
    mine = F.col("source").isin(*_KEPT_SOURCES)
    if never is not None:
        low = never.select(F.lower("value").alias("_never")).distinct()
        found = found.join(low, ~mine & (F.lower("value") == F.col("_never")), "left_anti")
    if ignored is not None:
        gone = ignored.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("value").alias("_ignored")).distinct()
        same = ~mine & (F.col("value") == F.col("_ignored"))
        for c in on:
            same = same & (F.col(c) == F.col(f"_{c}"))
        found = found.join(gone, same, "left_anti")
    return found


def group(spans: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each value of a document: kind and source of its first span, its spans, and its rank."""
    grouped = spans.groupBy(*key, "value").agg(
        F.min("start").alias("first_start"), F.min_by("kind", "start").alias("kind"), F.min_by("source", "start").alias("source"), F.count("*").alias("n_spans"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    return grouped.withColumn("candidate_order", F.row_number().over(Window.partitionBy(*key).orderBy("first_start", "value")).cast("long"))


def attach_variables(candidates: DataFrame, variables: DataFrame, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """The token of the variable with the same value, if there is one."""
    tokens = variables.select(*on, "value", F.col("token").alias("variable_token"))
    return candidates.join(tokens, [*on, "value"], "left")


def rule_listing(values: DataFrame, always: DataFrame, never: DataFrame) -> DataFrame:
    """values(value) with listing: blacklist (exact) before whitelist (any case), else null."""
    a = always.select("value").distinct().withColumn("_a", F.lit(True))
    n = never.select(F.lower("value").alias("_low")).distinct().withColumn("_n", F.lit(True))
    listed = values.join(a, "value", "left").join(n, F.lower(values["value"]) == F.col("_low"), "left")
    return listed.withColumn("listing", F.when(F.col("_a"), "blacklist").when(F.col("_n"), "whitelist")).drop("_a", "_n", "_low")


def add_always(always: DataFrame, never: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists after new(value, kind) went on the always list; a value is on one list at most."""
    fresh = new.join(always, "value", "left_anti").dropDuplicates(["value"])
    return always.unionByName(fresh), never.join(new.select("value"), "value", "left_anti")


def add_never(always: DataFrame, never: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    fresh = new.select("value").distinct().join(never, "value", "left_anti")
    return always.join(new.select("value"), "value", "left_anti"), never.unionByName(fresh)


def set_kinds(always: DataFrame, changes: DataFrame) -> DataFrame:
    """The always list after changes(value, new_kind); values that are not on it change nothing."""
    return always.join(changes.select("value", "new_kind"), "value", "left").withColumn("kind", F.coalesce("new_kind", "kind")).drop("new_kind")


def remove_values(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """A list without the values of gone, in their exact spelling."""
    return rules.join(gone.select("value").distinct(), "value", "left_anti")


def upsert_patterns(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """User patterns by id: new ones join, and those there are already are replaced."""
    return patterns.join(new.select("id"), "id", "left_anti").unionByName(new)


def include_rows(rows: DataFrame, include: bool, which: DataFrame | None = None, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Review rows with include set: all of them, or those of which(value)."""
    if which is None:
        return rows.withColumn("include", F.lit(include))
    chosen = which.select(*key, "value").distinct().withColumn("_chosen", F.lit(True))
    return rows.join(chosen, [*key, "value"], "left").withColumn("include", F.when(F.col("_chosen"), include).otherwise(F.col("include"))).drop("_chosen")


def merge_reviews(previous: DataFrame, candidates: DataFrame, whitelisted: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """previous(value, kind, include, manual, row_order) folded with candidates(value, kind, candidate_order).

    A candidate keeps the decision it has, or is included. A row that detection no longer offers stays
    only if it was typed in or is on the whitelist, at about its old place.
    """
    p = previous.select(*key, "value", F.col("kind").alias("_kind"), "include", "manual", "row_order")
    c = candidates.select(*key, "value", "kind", "candidate_order")
    w = whitelisted.select(F.lower("value").alias("_low")).distinct()
    both = p.join(c, [*key, "value"], "full").join(w, F.lower("value") == F.col("_low"), "left")
    stays = F.col("candidate_order").isNotNull() | F.coalesce(F.col("manual"), F.lit(False)) | F.col("_low").isNotNull()
    place = F.coalesce(F.col("candidate_order").cast("double"), F.col("row_order") - 0.5)
    order = Window.partitionBy(*key).orderBy(place, F.col("candidate_order").isNotNull(), "row_order", "value")
    return both.filter(stays).select(
        *key, "value", F.coalesce("_kind", "kind").alias("kind"), F.coalesce("include", F.lit(True)).alias("include"), F.coalesce("manual", F.lit(False)).alias("manual"),
        F.row_number().over(order).cast("long").alias("row_order"),
    )


def upsert_review(rows: DataFrame, new: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """rows(value, kind, include, manual) with new(value, kind, include): one that exists keeps its kind."""
    n = new.select(*key, "value", F.col("kind").alias("_kind"), F.col("include").alias("_include"))
    both = rows.join(n, [*key, "value"], "full")
    fresh = F.col("kind").isNull()
    return both.select(*key, "value", F.coalesce("kind", "_kind").alias("kind"), F.coalesce("_include", "include").alias("include"), F.when(fresh, True).otherwise(F.col("manual")).alias("manual"))


def rejected_values(rows: DataFrame, variables: DataFrame, whitelisted: DataFrame, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """Values that were left out, have no variable and are not on the whitelist: they are ignored from now on."""
    out = rows.filter(~F.col("include")).join(variables, [*on, "value"], "left_anti")
    w = whitelisted.select(F.lower("value").alias("_low")).distinct()
    return out.join(w, F.lower(out["value"]) == F.col("_low"), "left_anti").select(*on, "value").distinct()


def pattern_hits(text: Column, pattern: str) -> Column:
    """How many matches that aren't empty a pattern has."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: m != "")).cast("long")
