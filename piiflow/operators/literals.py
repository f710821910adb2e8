"""Literals from a table: every place in every text, and texts rewritten from them.

A literal is known by one of its words, that which the fewest literals have. A text is read once, word by
word: a word that some literal is known by gives the place where that literal would begin, and it is compared there. So a
pass costs the text's length and what nearly matches, however many literals there are.

Up to SENT_ROWS literals of SENT_CHARS in all go to every task, and the documents are not moved. More are joined to the
documents' distinct words, so that each document meets those literals whose word it has, and is then read in the same way.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from piiflow.functions.text import WORD
from piiflow.sources.stores import materialize

SENT_ROWS, SENT_CHARS = 100_000, 4_000_000
#: Of (text, places, values, of): the places to be kept, of being a column of the literals.
Choose = Callable[[str, list, Sequence[str], Sequence], list]


class Finder:
    """Some literals by the words they are known by, or by their first signs. Words are of letters, digits and, as WORD, the underscore."""

    def __init__(self, values: Sequence[str], suffixes: Sequence[str] = (), whole_word: bool = True, underscore: bool = True):
        self.suffixes, self.whole_word = ("", *suffixes), whole_word
        self.run, self.sign = re.compile(r"\w+" if underscore else r"[^\W_]+"), re.compile(r"\W" if underscore else r"[\W_]")
        self.by_word: dict[str, list[tuple[str, int, int]]] = {}
        self.by_start: dict[str, list[tuple[str, int]]] = {}
        words = [self._words(v) for v in values]
        shared = Counter(w for found in words for w in {w for _, w in found})
        for k, (value, found) in enumerate(zip(values, words)):
            self._put(value, k, found, shared)

    def _words(self, value: str) -> list[tuple[int, str]]:
        return [(m.start(), m.group()) for m in self.run.finditer(value)] if self.whole_word else []

    def _put(self, value: str, k: int, words: list[tuple[int, str]], shared: Counter) -> None:
        if value and not words:
            self.by_start.setdefault(value[0] if self.whole_word else value[:2], []).append((value, k))
        elif value:
            at, word = min(words, key=lambda x: (shared[x[1]], -len(x[1]), x[0]))
            self.by_word.setdefault(word, []).append((value, at, k))
            if at + len(word) == len(value):
                # A word that ends its literal may run into a suffix.
                for s in self.suffixes[1:]:
                    self.by_word.setdefault(word + s, []).append((value, at, k))

    def add(self, value: str, k: int) -> None:
        """One more literal, known by its longest word."""
        self._put(value, k, self._words(value), Counter())

    def _bounded(self, text: str, value: str, at: int) -> bool:
        if not self.whole_word:
            return True
        if at and self.run.match(value[0]) and self.run.match(text[at - 1]):
            return False
        end = at + len(value)
        return not self.run.match(value[-1]) or any(text.startswith(s, end) and not self.run.match(text, end + len(s)) for s in self.suffixes)

    def places(self, text: str | None) -> list[tuple[int, int]]:
        """(start, number of the literal) of all occurrences, also in each other."""
        out = set()
        if text and self.by_word:
            for m in self.run.finditer(text):
                for value, offset, k in self.by_word.get(m.group(), ()):
                    at = m.start() - offset
                    if at >= 0 and text.startswith(value, at) and self._bounded(text, value, at):
                        out.add((at, k))
        if text and self.by_start:
            starts = (m.start() for m in self.sign.finditer(text)) if self.whole_word else range(len(text))
            for at in starts:
                for n in (1,) if self.whole_word else (1, 2):
                    for value, k in self.by_start.get(text[at : at + n], ()) if at + n <= len(text) else ():
                        if text.startswith(value, at):
                            out.add((at, k))
        return sorted(out)


def longest_first(places: Sequence[tuple[int, int]], values: Sequence[str]) -> list[tuple[int, int]]:
    """Places without overlaps, in text order: longer ones win, then earlier ones."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for at, k in sorted(places, key=lambda p: (-len(values[p[1]]), p[0])):
        end = at + len(values[k])
        i = bisect_left(starts, at)
        if (i == len(starts) or end <= starts[i]) and (i == 0 or kept[i - 1][1] <= at):
            starts.insert(i, at)
            kept.insert(i, (at, end, k))
    return [(at, k) for at, _, k in kept]


def _rewritten(text: str, places: Sequence[tuple[int, int]], values: Sequence[str], replacements: Sequence[str]) -> str:
    out, upto = [], 0
    for at, k in places:
        out += [text[upto:at], replacements[k]]
        upto = at + len(values[k])
    return "".join([*out, text[upto:]])


def _sent(literals: DataFrame) -> pa.Table | None:
    """All literals, if they are few and short enough to go to every task."""
    size = literals.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("chars")).first()
    return literals.toArrow() if size.n <= SENT_ROWS and size.chars <= SENT_CHARS else None


def _by_group(table: pa.Table, on: Sequence[str], *how) -> dict[tuple, tuple[Finder, list[int], list[str]]]:
    """Of each group of literals how to find them, the row of each in the table, and their values."""
    rows: dict[tuple, list[int]] = {}
    keys = zip(*(table[c].to_pylist() for c in on)) if on else iter([()] * table.num_rows)
    for k, group in enumerate(keys):
        if None not in group:
            rows.setdefault(group, []).append(k)
    values = table["value"].to_pylist()
    of = {g: [values[k] for k in ks] for g, ks in rows.items()}
    return {g: (Finder(of[g], *how), rows[g], of[g]) for g in rows}


def _groups(batch: pa.RecordBatch, on: Sequence[str]) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in on)) if on else iter([()] * batch.num_rows)


def _lazily(spark, table: pa.Table, on: Sequence[str], *how) -> Callable[[], tuple[pa.Table, dict]]:
    """The literals as a task has them: sent once to each executor, made ready once in each worker."""
    sent = spark.sparkContext.broadcast(table.combine_chunks())
    ready: list = []

    def get() -> tuple[pa.Table, dict]:
        if not ready:
            ready.extend((sent.value, _by_group(sent.value, on, *how)))
        return ready[0], ready[1]

    return get


def _candidates(docs: DataFrame, literals: DataFrame, on: Sequence[str], columns: Sequence[str], suffixes: Sequence[str], whole_word: bool, underscore: bool) -> DataFrame:
    """For each document that has some, the literals whose word it has: columns and _literals."""
    carried = [c for c in literals.columns if c not in columns]
    word = WORD if underscore else r"[\p{L}\p{N}]"
    if whole_word:
        words = literals.select(*on, "value", F.posexplode(F.regexp_extract_all("value", F.lit(f"{word}+"), F.lit(0))).alias("_at", "_word")).distinct()
        shared = words.groupBy(*on, "_word").agg(F.count_distinct("value").alias("_n"))
        rarest = words.join(shared.hint("merge"), [*on, "_word"]).groupBy(*on, "value").agg(F.min_by("_word", F.struct("_n", -F.length("_word"), "_at")).alias("_word"))
        literals = literals.join(rarest.hint("merge"), [*on, "value"], "left")
        plain = F.coalesce("_word", F.substr("value", F.lit(1), F.lit(1)))
        with_suffix = F.col("_word").isNotNull() & F.col("value").endswith(F.col("_word"))
        anchors = F.when(with_suffix, F.array(plain, *[F.concat(plain, F.lit(s)) for s in suffixes])).otherwise(F.array(plain))
        tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(f"{word}+|[^{word[1:]}"), F.lit(0)))
    else:
        anchors = F.array(F.substr("value", F.lit(1), F.lit(2)))
        pairs = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substr("text", i, F.lit(2)))
        tokens = F.when(F.length("text") > 0, F.array_distinct(F.concat(pairs, F.transform(pairs, lambda p: F.substr(p, F.lit(1), F.lit(1))))))
    # Files of a few MB hold millions of literals: sent to all by the size of their files, they would fill the driver.
    wanted = materialize(literals.select(*on, F.struct(*carried).alias("_literal"), F.explode(anchors).alias("_token")))
    found = docs.select(*columns, F.explode(tokens).alias("_token")).join(wanted.hint("merge"), [*on, "_token"])
    return found.groupBy(*columns).agg(F.collect_set("_literal").alias("_literals")).hint("merge")


def _values(literals) -> list[str]:
    return [x["value"] for x in literals.as_py() or ()]


def find_literals(docs: DataFrame, literals: DataFrame, on: Sequence[str] = (), key: Sequence[str] = ("doc_id",), suffixes: Sequence[str] = (), whole_word: bool = True, underscore: bool = True, choose: Choose | None = None, of: str = "value") -> DataFrame:
    """Every occurrence of literals(value, ...) in docs(text), also in each other: the key, start, end and the literal's columns.

    on: columns that both tables share, such as a project. key: columns that name a document. A whole
    word may run into one of suffixes, which stays outside the span. Empty and null literals match nothing. Without
    underscore, that is no part of a word. choose picks from a text's places, told the literals' values and their column of.
    """
    how = (suffixes, whole_word, underscore)
    literals = literals.filter(F.length("value") > 0)
    columns = [*key, *(c for c in on if c not in key)]
    carried = [c for c in literals.columns if c not in columns]
    schema = StructType([*docs.select(*columns).schema.fields, StructField("start", LongType()), StructField("end", LongType()), *literals.select(*carried).schema.fields])
    table = _sent(literals)
    if table is None:
        met = docs.select(*columns, "text").join(_candidates(docs, literals, on, columns, *how), columns)
        placed = StructType([*met.drop("text").schema.fields, *StructType.fromDDL("_hits array<struct<at:bigint,k:int>>").fields])

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("at", pa.int64()), ("k", pa.int32())]))
            for batch in batches:
                found = []
                for text, own in zip(batch["text"].to_pylist(), batch["_literals"].to_pylist()):
                    values = [x["value"] for x in own]
                    places = Finder(values, *how).places(text)
                    found.append([{"at": at, "k": k} for at, k in (choose(text, places, values, [x[of] for x in own]) if choose else places)])
                kept = batch.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, kind)], [*kept.schema.names, "_hits"])

        rows = met.mapInArrow(hits, placed).select(*columns, "_literals", F.explode("_hits").alias("_h"))
        rows = rows.select(*columns, F.col("_h.at").alias("start"), F.get("_literals", F.col("_h.k")).alias("_l"))
        rows = rows.withColumn("end", F.col("start") + F.length("_l.value"))
        return rows.select(*columns, "start", "end", *[F.col("_l")[c].alias(c) for c in carried]).distinct()
    get = _lazily(docs.sparkSession, table, on, *how)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, groups = get()
        column = known[of].to_pylist() if choose else []
        told = {g: [column[k] for k in numbers] for g, (_, numbers, _) in groups.items()} if choose else {}
        for batch in batches:
            rows, starts, ends, which = [], [], [], []

            def part() -> pa.RecordBatch:
                own = known.take(pa.array(which, pa.int64()))
                places = [pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
                taken = batch.select(columns).take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*taken.columns, *places, *[own[c].combine_chunks() for c in carried]], [*columns, "start", "end", *carried])

            for row, (group, text) in enumerate(zip(_groups(batch, on), batch["text"])):
                if group in groups:
                    finder, numbers, values = groups[group]
                    places = finder.places(text.as_py())
                    if choose and places:
                        places = choose(text.as_py(), places, values, told[group])
                    for at, k in places:
                        rows.append(row)
                        starts.append(at)
                        ends.append(at + len(values[k]))
                        which.append(numbers[k])
                if len(rows) > 100_000:
                    yield part()
                    rows, starts, ends, which = [], [], [], []
            if rows:
                yield part()

    return docs.select(*columns, "text").mapInArrow(found, schema).distinct()


def replace_literals(docs: DataFrame, pairs: DataFrame, on: Sequence[str] = (), key: Sequence[str] = ("doc_id",), suffixes: Sequence[str] = ()) -> DataFrame:
    """docs with text rewritten by pairs(value, replacement), longest first where they cross, and n_replaced.

    Of pairs with one value, the first by seq counts, where there is a seq.
    """
    order = F.struct(F.col("seq"), F.col("replacement")) if "seq" in pairs.columns else F.col("replacement")
    pairs = pairs.filter((F.length("value") > 0) & F.col("replacement").isNotNull()).groupBy(*on, "value").agg(F.min_by("replacement", order).alias("replacement"))
    docs = docs.drop("n_replaced")
    schema = StructType([*docs.schema.fields, StructField("n_replaced", LongType())])

    def edited(batch: pa.RecordBatch, edits: Iterator[tuple | None]) -> pa.RecordBatch:
        texts, counts = [], []
        for text, edit in zip(batch["text"].to_pylist(), edits):
            places = longest_first(edit[0].places(text), edit[1]) if edit else ()
            texts.append(_rewritten(text, places, *edit[1:]) if places else text)
            counts.append(len(places))
        own = {"text": pa.array(texts, pa.string()), "n_replaced": pa.array(counts, pa.int64())}
        return pa.RecordBatch.from_arrays([own[c] if c in own else batch[c] for c in schema.names], schema.names)

    table = _sent(pairs)
    if table is None:
        columns = [*key, *(c for c in on if c not in key)]
        met = docs.join(_candidates(docs, pairs, on, columns, suffixes, True, True), columns, "left")

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = lambda x: (Finder(_values(x), suffixes), _values(x), [y["replacement"] for y in x.as_py()]) if x.is_valid else None
            for batch in batches:
                yield edited(batch, map(of, batch["_literals"]))

        return met.mapInArrow(joined, schema)
    get = _lazily(docs.sparkSession, table, on, suffixes)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, groups = get()
        replacements = known["replacement"].to_pylist()
        of = {g: (finder, values, [replacements[k] for k in numbers]) for g, (finder, numbers, values) in groups.items()}
        for batch in batches:
            yield edited(batch, map(of.get, _groups(batch, on)))

    return docs.mapInArrow(sent, schema)
