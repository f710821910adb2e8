"""The algebra of spans: find, resolve overlaps, rewrite.

Everything that happens inside one text is a Column over that row's arrays: no shuffle, and one scan of
the documents however many patterns there are. Literals from a table are in literals.py. Positions count
code points.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.schema import SPAN, SPANS

Accept = Callable[[Column], Column]


def _span(start: Column, value: Column, kind: str | Column, source: str | Column, priority: int | Column, seq: int | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = {"start": start, "end": start + F.length(value), "value": value, "kind": lit(kind), "source": lit(source), "priority": lit(priority), "seq": lit(seq)}
    return F.struct(*[c.alias(k) for k, c in fields.items()]).cast(SPAN)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column, block: int = 16, tiers: int = 2) -> Column:
    """For each of an array's numbers the sum of those before it. Arrays grow by blocks only, so long ones stay cheap, and so do sums of blocks.

    steps are computed once: what a lambda names is computed anew for each element.
    """
    grow = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    inside = lambda part, start: F.slice(F.aggregate(part, F.array(start), grow), F.lit(1), F.size(part))
    if not tiers:
        return let(steps, lambda all_: inside(all_, F.lit(0).cast("long")))

    def cut(all_: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / block).cast("int"))
        return F.transform(cuts, lambda k: F.slice(all_, k * block + 1, F.lit(block)))

    def summed(p: Column) -> Column:
        before = running(F.transform(p, total), block, tiers - 1)
        return let(before, lambda at: F.flatten(F.transform(p, lambda part, k: inside(part, F.get(at, k)))))

    return let(let(steps, cut), summed)


#: Control signs (ENQ, ACK) that hardly a text holds; they are of one byte, so that marked texts stay small.
_OPEN, _SHUT = "\x05", "\x06"


def _marked(text: Column, pattern: str) -> Column:
    """A text cut before and after each match that isn't empty, for a pattern that matches nothing nearly everywhere: every second piece is a match.

    What it finds is marked, and empty marks are taken out again at once.
    """
    marked = F.replace(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_SHUT}")), F.lit(_OPEN + _SHUT), F.lit(""))
    return F.split(F.replace(marked, F.lit(_SHUT), F.lit(_OPEN)), _OPEN, -1)


def _placed(text: Column, pattern: str, often_empty: bool, shape: Callable[[Column, Column, Column], Column]) -> Column:
    """shape(start, value, before) of all matches, from left to right.

    Where a pattern matches nothing, the search goes on one sign later. Splitting parts the text there too, but for a match of
    nothing at the very start, which is the one that has no gap of its own.
    """
    long = lambda s: F.length(s).cast("long")

    def placed(p: Column) -> Column:
        gap = lambda i: F.get(p["gaps"], i)
        steps = F.transform(p["found"], lambda m, i: long(gap(i)) + F.length(m))
        return let(running(steps), lambda at: F.transform(p["found"], lambda m, i: shape(F.get(at, i) + F.length(gap(i)), m, gap(i))))

    def aligned(p: Column) -> Column:
        found = F.when(F.size(p["gaps"]) == F.size(p["found"]), F.slice(p["found"], F.lit(2), F.greatest(F.size(p["found"]) - 1, F.lit(0)))).otherwise(p["found"])
        return F.struct(found.alias("found"), p["gaps"].alias("gaps"))

    def pieced(p: Column) -> Column:
        piece = lambda i: F.get(p, i)
        steps = F.transform(F.slice(p, F.lit(1), F.floor(F.size(p) / 2).cast("int")), lambda _, k: long(piece(2 * k)) + F.length(piece(2 * k + 1)))
        return let(running(steps), lambda sums: F.transform(sums, lambda at, k: shape(at + F.length(piece(2 * k)), piece(2 * k + 1), piece(2 * k))))

    plain = let(let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), aligned), placed)
    if not often_empty:
        return plain
    return F.when(F.rlike(text, F.lit(f"[{_OPEN}{_SHUT}]")), plain).otherwise(let(_marked(text, pattern), pieced))


def matches(text: Column, pattern: str, often_empty: bool = False) -> Column:
    """All matches from left to right that don't overlap and aren't empty: (start, value, before), before being the text since the last one."""
    match = lambda start, value, before: F.struct(start.alias("start"), value.alias("value"), before.alias("before"))
    return F.filter(_placed(text, pattern, often_empty, match), lambda m: m["value"] != "")


def values(text: Column, pattern: str, often_empty: bool = False) -> Column:
    """The texts of matches alone, for what needs no places: counting them costs a fraction of find_spans."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: v != "")
    if often_empty:
        found = F.when(F.rlike(text, F.lit(f"[{_OPEN}{_SHUT}]")), found).otherwise(F.filter(_marked(text, pattern), lambda _, k: k % 2 == 1))
    return F.coalesce(found, F.array().cast("array<string>"))


def find_spans(text: Column, pattern: str, kind: str, source: str, priority: int = 0, seq: int = 0, accept: Accept | None = None, often_empty: bool = False) -> Column:
    """All matches from left to right that don't overlap, as an array of spans. often_empty: the pattern matches the empty string.

    accept vetoes a match after it has used up its characters. Matches of nothing are no spans. Matches and the gaps between them see the same whole text, so look-around works.
    """
    spans = F.filter(_placed(text, pattern, often_empty, lambda start, value, _: _span(start, value, kind, source, priority, seq)), lambda s: s["value"] != "")
    if accept is not None:
        spans = F.filter(spans, lambda s: F.coalesce(accept(s["value"]), F.lit(False)))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(no_spans())


def pool(*spans: Column) -> Column:
    """Spans of several sources, in their order."""
    return F.concat(*spans) if spans else no_spans()


def _sorted(spans: Column, key: Callable[[Column], list[Column]]) -> Column:
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key(s))], s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def resolve(spans: Column) -> Column:
    """A subset without overlaps: the longest first, then the higher priority, the earlier, and seq.

    Not the leftmost: a long span beats a shorter one that begins before it. In text order.
    """
    ranked = _sorted(spans, lambda s: [s["start"] - s["end"], -F.coalesce(s["priority"], F.lit(0)), s["start"], s["seq"]])
    kept = F.aggregate(
        ranked, no_spans(), lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc).otherwise(F.array_append(acc, s))
    )
    return _sorted(kept, lambda s: [s["start"]])


def longest_first(spans: Sequence[tuple]) -> list[int]:
    """Which of spans (start, end, priority, seq) resolve() keeps, by bisection: sorting is what costs most."""
    starts: list[int] = []
    kept: list[tuple[int, int]] = []
    for k in sorted(range(len(spans)), key=lambda k: (spans[k][0] - spans[k][1], -(spans[k][2] or 0), spans[k][0], spans[k][3])):
        start, end = spans[k][:2]
        i = bisect_left(starts, start)
        if (i == len(starts) or end <= starts[i]) and (i == 0 or spans[kept[i - 1][1]][1] <= start):
            starts.insert(i, start)
            kept.insert(i, (start, k))
    return [k for _, k in kept]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those that stay; a cluster begins where _opens is 1. What is held is one batch, or one cluster."""

    def settled(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(parts)
        bounds = np.append(np.flatnonzero(rows["_opens"].to_numpy()), rows.num_rows)
        alone = np.diff(bounds) == 1
        kept = bounds[:-1][alone].tolist()
        spans = list(zip(*(rows[c].to_pylist() for c in ("start", "end", "priority", "seq")))) if not alone.all() else []
        for begin, end in zip(bounds[:-1][~alone].tolist(), bounds[1:][~alone].tolist()):
            kept += [begin + k for k in longest_first(spans[begin:end])]
        return rows.drop_columns(["_opens"]).take(pa.array(kept, pa.int64()))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        opens = np.flatnonzero(batch["_opens"].to_numpy())
        if held and len(opens):
            yield settled([*held, batch.slice(0, opens[-1])])
            held = [batch.slice(opens[-1])]
        elif len(opens) and opens[-1]:
            yield settled([batch.slice(0, opens[-1])])
            held = [batch.slice(opens[-1])]
        else:
            held.append(batch)
    if any(b.num_rows for b in held):
        yield settled(held)


def resolved(spans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """resolve() for a table of spans, one row each: columns name a document.

    Spans that overlap, directly or through others, make a cluster; only the spans of a cluster are compared, and each with its
    neighbours among the kept ones. So a document costs no more than sorting its spans, also where all are one chain.
    """
    order = Window.partitionBy(*columns).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("_opens", (F.col("start") >= F.coalesce(reach, F.col("start"))).cast("long"))
    span = F.struct("start", "end", "value", "kind", "source", "priority", "seq").cast(SPAN)
    # The rows lie sorted by the window already, so that they need no lists.
    rows = opens.select(*columns, "_opens", span.alias("_s")).select(*columns, "_opens", "_s.*").sortWithinPartitions(*columns, "start", "end")
    return rows.mapInArrow(_kept, rows.drop("_opens").schema)


_EDITS = "array<struct<start:bigint,end:bigint,what:string>>"


def _in_order(spans: Column, body: Callable[[Column], Column]) -> Column:
    """body of spans (start, end, what) in text order; one that begins before the last one's end is skipped.

    Spans that don't cross, which is what there nearly always is, are only sorted.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_EDITS).alias("out"))
    step = lambda acc, e: F.when(e["start"] < acc["at"], acc).otherwise(F.struct(e["end"].alias("at"), F.array_append(acc["out"], e).alias("out")))

    def uncrossed(all_: Column) -> Column:
        crossing = F.exists(F.sequence(F.lit(1), F.size(all_)), lambda i: F.coalesce(F.get(all_, i)["start"] < F.get(all_, i - 1)["end"], F.lit(False)))
        return let(F.when(crossing, F.aggregate(all_, start, step, lambda acc: acc["out"])).otherwise(all_), body)

    return let(F.sort_array(spans.cast(_EDITS)), uncrossed)


def _upto(kept: Column, i: Column) -> Column:
    """Where the span before the i-th ends."""
    return F.coalesce(F.get(kept, i - 1)["end"], F.lit(0).cast("long"))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))


def rewrite(text: Column, edits: Column) -> Column:
    """text with edits, an array of (start, end, replacement); one that begins before the last one's end is skipped."""
    edit = lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["replacement"].alias("what"))

    def joined(kept: Column) -> Column:
        pieces = F.transform(kept, lambda e, i: F.concat(_cut(text, _upto(kept, i), e["start"]), e["what"]))
        return F.concat(F.array_join(pieces, ""), F.substr(text, (_upto(kept, F.size(kept)) + 1).cast("int")))

    return F.when(F.size(edits) > 0, _in_order(F.transform(edits, edit), joined)).otherwise(text)


def highlight(text: Column, spans: Column) -> Column:
    """text cut into pieces: (piece, kind), kind being null outside of spans."""
    mark = lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["kind"].alias("what"))
    piece = lambda start, end, kind: F.struct(_cut(text, start, end).alias("piece"), kind.alias("kind"))
    plain = F.lit(None).cast("string")

    def cut(kept: Column) -> Column:
        both = F.transform(kept, lambda s, i: F.array(piece(_upto(kept, i), s["start"], plain), piece(s["start"], s["end"], s["what"])))
        rest = piece(_upto(kept, F.size(kept)), F.length(text).cast("long"), plain)
        return F.filter(F.concat(F.flatten(both), F.array(rest)), lambda p: p["piece"] != "")

    return _in_order(F.transform(spans, mark), cut)


def occurrences(text: Column, value: Column) -> Column:
    """Starts of a value in a text, from left to right, without overlaps and without word bounds."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)

    def placed(g: Column) -> Column:
        steps = F.transform(F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))), lambda x: (F.length(x) + F.length(value)).cast("long"))
        return F.zip_with(running(steps), F.slice(g, F.lit(1), F.size(steps)), lambda at, x: at + F.length(x))

    return F.when(F.length(value) > 0, let(gaps, placed)).otherwise(F.array().cast("array<bigint>"))


def exploded(docs: DataFrame, spans: Column, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each span, with the document's key."""
    return docs.select(*key, F.inline(spans))
