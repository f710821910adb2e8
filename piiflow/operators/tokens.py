"""Minting placeholders for values, and rewriting texts to placeholders and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.functions.placeholders import KIND_STYLES, STYLES, format_placeholder, kind_slug
from piiflow.operators.literals import find_literals, replace_literals
from piiflow.operators.spans import let
from piiflow.sources.stores import materialize

SUFFIXES = ("s",)


def counter(style: str, kind: Column) -> Column:
    """Kinds that share a counter: those that read alike in a placeholder."""
    slug = kind_slug(kind)
    if style not in KIND_STYLES:
        return F.lit("")
    return F.lower(slug) if style == "mustache" else F.upper(slug)


#: Up to so many rows a mint numbers in one window for each counter; more are dealt by ranges, with the same result.
ONE_WINDOW = 1_000_000


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, value: Column, how: Callable[[Column], Column], few: bool = False) -> DataFrame:
    """df with how (a sum or maximum) of value over the rows of its group up to each, in an order without ties.

    Rows are dealt by ranges of the order, and what the ranges have says how much lies before each: no task gets
    all rows of a group, unless they are few. Written once, so that a task that runs again finds the same ranges.
    """
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if few:
        return df.withColumn(name, how(value).over(upto(*by)))
    dealt = materialize(df.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*by, "_range").agg(how(F.col("_value")).alias("_of")).withColumn("_before", how(F.col("_of")).over(earlier)).drop("_of")
    inside = dealt.withColumn("_inside", how(F.col("_value")).over(upto(*by, "_range")))
    both = how is F.sum and F.coalesce("_before", F.lit(0)) + F.col("_inside")
    return inside.join(ranges, [*by, "_range"]).withColumn(name, F.greatest("_before", "_inside") if how is F.max else both).drop("_range", "_before", "_inside", "_value")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, few: bool = False) -> DataFrame:
    """df with the number of each row in its group, in an order without ties, from 1."""
    return running(df, by, order, name, F.lit(1).cast("long"), F.sum, few)


def read_numbers(token: Column, style: str) -> Column:
    """The counters and numbers that a token may stand for in a style: A11 is the 11th of A and the first of A1."""
    one = lambda counter, n: F.array(F.struct(counter.alias("_counter"), n.alias("_t")))
    none = F.array().cast("array<struct<_counter:string,_t:bigint>>")
    if style in ("upperLetters", "lowerLetters"):
        letters = F.when(F.rlike(token, F.lit("^[A-Za-z]{3,12}$")), F.split(F.upper(token), ""))
        n = F.aggregate(letters, F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 65) + 1
        found = one(F.lit(""), n)
        return F.when(format_placeholder(style, n, F.lit("x")) == token, found).otherwise(none)
    if style == "dollarNumber":
        return F.when(F.rlike(token, F.lit(r"^\$[1-9][0-9]{0,17}\z")), one(F.lit(""), F.substr(token, F.lit(2)).try_cast("long"))).otherwise(none)
    if style == "bracketKind":
        form = r"^\[(.*) ([1-9][0-9]{0,17})\]\z"
        return F.when(F.rlike(token, F.lit(form)), one(F.regexp_extract(token, form, 1), F.regexp_extract(token, form, 2).try_cast("long"))).otherwise(none)
    inner = F.when(F.rlike(token, F.lit(r"^\{\{.*[0-9]\}\}\z")), F.substr(token, F.lit(3), F.length(token) - 4)) if style == "mustache" else token
    digits = F.length(F.regexp_extract(inner, r"[0-9]*\z", 0))
    split = lambda k: F.struct(F.substr(inner, F.lit(1), F.length(inner) - k).alias("_counter"), F.right(inner, k).alias("_d"))
    cuts = F.when(digits > 0, F.transform(F.sequence(F.lit(1), F.least(digits, F.lit(18))), split)).otherwise(F.array().cast("array<struct<_counter:string,_d:string>>"))
    whole = F.filter(cuts, lambda c: ~c["_d"].startswith("0"))
    return F.coalesce(F.transform(whole, lambda c: F.struct(c["_counter"].alias("_counter"), c["_d"].try_cast("long").alias("_t"))), none)


def _numbers(ranked: DataFrame, taken: DataFrame, style: str, on: Sequence[str], few: bool) -> DataFrame:
    """ranked with _i, how many numbers in use lie before the free one of its rank.

    Before the i-th number in use, t, there are t - i free ones. So what ranks beyond that, up to the next number in
    use, is moved by i: numbers in use become the beginnings of intervals of ranks, and no free number is listed.
    """
    by = [*on, "_counter"]
    used = taken.select(*on, F.inline(read_numbers(F.col("token"), style))).join(ranked.select(*by).distinct(), by, "left_semi").distinct()
    used = numbered(used, by, ["_t"], "_i", few)
    starts = used.select(*by, (F.col("_t") - F.col("_i")).alias("_at"), F.lit(0).alias("_new"), "_i", F.lit("").alias("value"))
    placed = starts.unionByName(ranked.select(*by, (F.col("_rank") - 1).alias("_at"), F.lit(1).alias("_new"), F.lit(None).cast("long").alias("_i"), "value"))
    moved = running(placed, by, ["_at", "_new", "_i", "value"], "_moved", F.col("_i"), F.max, few).filter("_new = 1")
    return ranked.join(moved.select(*by, "value", F.coalesce("_moved", F.lit(0).cast("long")).alias("_i")), [*by, "value"])


def mint(new: DataFrame, taken: DataFrame, style: str, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """new(value, kind, mint_order) with tokens: the free numbers of each counter in order, gaps first.

    taken(token): tokens of the project that are in use; their numbers are read back, and the gaps between these are
    intervals that ranks of new values are looked up in. Where two kinds format alike in
    spite of different counters (A and number 11, A1 and number 1), the later value in mint_order is
    minted once more beside all that is taken by then, until no token comes twice. Each round settles one value
    of every token at least.
    """
    new, done = new.withColumn("_counter", counter(style, F.col("kind"))), None
    sizes = new.select(F.lit(0).alias("t")).unionAll(taken.select(F.lit(1).alias("t"))).agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("taken")).first()
    few, some_taken = sizes.n <= ONE_WINDOW, sizes.taken > 0
    while True:
        ranked = numbered(new, [*on, "_counter"], ["mint_order", "value"], "_rank", few)
        if some_taken:
            ranked = _numbers(ranked, taken, style, on, few)
        number = F.col("_rank") + (F.col("_i") if some_taken else F.lit(0))
        minted = ranked.withColumn("token", format_placeholder(style, number, F.col("kind"))).drop("_rank", "_i")
        if style not in ("kindNumber", "mustache"):
            return minted.drop("_counter")
        first = F.row_number().over(Window.partitionBy(*on, "token").orderBy("mint_order", "value"))
        minted = materialize(minted.withColumn("_first", first))
        good = minted.filter("_first = 1").drop("_first")
        done = good if done is None else done.unionByName(good)
        again = minted.filter("_first > 1")
        if again.isEmpty():
            return done.drop("_counter")
        taken, some_taken = taken.select(*on, "token").unionByName(good.select(*on, "token")), True
        new = again.drop("_first", "token")


def plan(decisions: DataFrame, variables: DataFrame, style: str, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """variables after decisions(value, kind, include, decision_order): what is included and has no token gets one.

    Variables that a project has stay and are applied, also where their row is not included.
    """
    fresh = decisions.filter(F.col("include") & (F.length("value") > 0)).join(variables, [*on, "value"], "left_anti")
    fresh = fresh.groupBy(*on, "value").agg(F.min("decision_order").alias("mint_order"), F.min_by("kind", "decision_order").alias("kind"))
    fresh = materialize(fresh)
    minted = mint(fresh, variables.select(*on, "token"), style, on)
    last = variables.groupBy(*on).agg(F.max("variable_order").alias("_last"))
    minted = numbered(minted, list(on), ["mint_order", "value"], "_k", fresh.count() <= ONE_WINDOW).join(last, list(on), "left")
    minted = minted.select(*on, "value", "token", "kind", (F.coalesce("_last", F.lit(0)) + F.col("_k")).cast("long").alias("variable_order"))
    return variables.select(*on, "value", "token", "kind", "variable_order").unionByName(minted)


def mask(docs: DataFrame, variables: DataFrame, on: Sequence[str] = ("project_id",), key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs with values replaced by tokens; a genitive s stays behind."""
    pairs = variables.select(*on, "value", F.col("token").alias("replacement"), F.col("variable_order").alias("seq"))
    return replace_literals(docs, pairs, on, key, SUFFIXES)


def unmask(docs: DataFrame, variables: DataFrame, on: Sequence[str] = ("project_id",), key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs with tokens replaced by values, whole words and in their case only."""
    pairs = variables.select(*on, F.col("token").alias("value"), F.col("value").alias("replacement"), F.col("variable_order").alias("seq"))
    return replace_literals(docs, pairs, on, key, SUFFIXES)


def tokens_present(docs: DataFrame, variables: DataFrame, on: Sequence[str] = ("project_id",), key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The variables whose token stands in a document."""
    literals = variables.select(*on, F.col("token").alias("value"), F.col("value").alias("original"))
    hits = find_literals(docs, literals, on, key, SUFFIXES)
    return hits.select(*key, *(c for c in on if c not in key), F.col("value").alias("token"), F.col("original").alias("value")).distinct()


def token_in_text(docs: DataFrame, variables: DataFrame, on: Sequence[str] = ("project_id",), key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """An audit: source texts that hold a token already, so that restoring would change them."""
    return tokens_present(docs, variables, on, key)


def was_minted_for(token: Column, style: str, kind: Column, bound: Column) -> Column:
    """Whether a token is the placeholder of one of the first bound numbers: its number is read back and formatted anew."""
    if style in ("upperLetters", "lowerLetters"):
        number = F.get(read_numbers(token, style), F.lit(0))["_t"]
    else:
        after = {"bracketKind": 1, "mustache": 2}.get(style, 0)
        before = F.length(format_placeholder(style, F.lit(1), kind)) - 1 - after
        number = F.substr(token, before + 1, F.length(token) - before - after).try_cast("long")
    same = lambda n: (n >= 1) & (n <= F.greatest(bound, F.lit(1))) & (format_placeholder(style, n, kind) == token)
    return F.coalesce(let(number, same), F.lit(False))


def retoken(variables: DataFrame, changes: DataFrame, style: str, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """variables after changes(value, new_kind): a minted token follows its kind, one typed by hand stays.

    The changes of a project are minted together, each free of its old token, in the variables' order.
    """
    sizes = variables.groupBy(*on).agg((F.count("*") + 1).alias("_size"))
    changed = variables.join(changes.select(*on, "value", "new_kind"), [*on, "value"], "left").join(sizes, list(on))
    changed = changed.withColumn("_minted", F.col("new_kind").isNotNull() & was_minted_for(F.col("token"), style, F.col("kind"), F.col("_size")))
    moving = changed.filter("_minted").select(*on, "value", F.col("new_kind").alias("kind"), F.col("variable_order").alias("mint_order"))
    fixed = changed.filter("NOT _minted").select(*on, "value", "token", F.coalesce("new_kind", "kind").alias("kind"), "variable_order")
    minted = mint(moving, fixed.select(*on, "token"), style, on)
    return fixed.unionByName(minted.select(*on, "value", "token", "kind", F.col("mint_order").alias("variable_order")))


def upsert_variable(variables: DataFrame, new: DataFrame, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """variables with new ones whose value and token are both free."""
    fresh = new.join(variables, [*on, "value"], "left_anti").join(variables.select(*on, "token"), [*on, "token"], "left_anti")
    one = fresh.withColumn("_v", F.row_number().over(Window.partitionBy(*on, "value").orderBy("variable_order", "token"))).filter("_v = 1")
    one = one.withColumn("_t", F.row_number().over(Window.partitionBy(*on, "token").orderBy("variable_order", "value"))).filter("_t = 1")
    return variables.unionByName(one.select(variables.columns))


def update_variables(variables: DataFrame, changes: DataFrame, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """variables with new_value and new_token of changes(value, new_value, new_token), where these are not null."""
    both = variables.join(changes.select(*on, "value", "new_value", "new_token"), [*on, "value"], "left")
    return both.withColumns({"value": F.coalesce("new_value", "value"), "token": F.coalesce("new_token", "token")}).select(variables.columns)


def remove_variables(variables: DataFrame, gone: DataFrame, on: Sequence[str] = ("project_id",)) -> DataFrame:
    return variables.join(gone.select(*on, "value").distinct(), [*on, "value"], "left_anti")


def unignore(ignored: DataFrame, added: DataFrame, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """The ignored values of projects, without those that have a variable now."""
    return ignored.join(added.select(*on, "value"), [*on, "value"], "left_anti")


def project_style(style: Column, fallback: str) -> Column:
    """A project's own style, or the setting where it has none that is known."""
    return F.when(style.isin(*STYLES), style).otherwise(F.lit(fallback))


def export_tsv(variables: DataFrame, on: Sequence[str] = ("project_id",)) -> DataFrame:
    """Each project's variables as token, value and kind, a line each."""
    line = F.concat_ws("\t", "token", "value", "kind")
    lines = variables.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("variable_order", line.alias("line")))).alias("_l"))
    return lines.select(*on, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("tsv"))
