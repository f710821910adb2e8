"""Benchmark decontamination: suffix arrays over the training words, searched for every test suffix.

The documents are cut into shards of bounded size. A shard's words become numbers of the benchmark's
vocabulary (0: not in it), and its suffixes are sorted into a suffix array, by the first words of each
and then, where suffixes still tie, by the place of the suffix three, six, twelve words on. A suffix
that begins with a word outside the vocabulary can't match any test suffix by a word and is left out;
nothing else is. Every test suffix that is long enough for a window is binary-searched in each shard: the
range of suffixes that begin with its window gives all places where it occurs, equal windows being
searched once. From each such place the document's own suffix is searched in the suffix array of the
tests, where its neighbours say how far the longest verbatim match goes and in which item it lies.
Documents don't leave their shard, so no text is shuffled.

The benchmark goes to the tasks in one block of at most BLOCK_CHARS characters. Only a larger benchmark has
further blocks; each reads the texts again, and what is shuffled are the documents that it hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import spread, table, written

WINDOW = 10
BLOCK_CHARS = 64_000_000
SHARD_BYTES = 8_000_000

#: Digits, A-Z (made lower case), a-z and all bytes of characters beyond ASCII are parts of words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
#: An odd multiplier and its inverse modulo 2 ** 64, and a random number for every byte.
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the words of UTF-8 bytes."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every lower-cased word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = _BYTE[_LOWER[data]]
    with np.errstate(over="ignore"):
        longest = int((ends - starts).max())
        if longest <= 64:
            # Words of one length at a time are summed by columns.
            out = np.zeros(len(starts), np.uint64)
            power = _powers(_BASE, longest)
            lengths = ends - starts
            order = np.argsort(lengths, kind="stable")[::-1]
            first, n = starts[order], lengths[order]
            sums = np.zeros(len(starts), np.uint64)
            for k in range(longest):
                m = int(np.searchsorted(-n, -k, "left"))  # words longer than k come first
                sums[:m] += values[first[:m] + k] * power[k]
            out[order] = sums
        else:
            power = _powers(_BASE, len(data))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power)))
            inverse = _powers(pow(_BASE, -1, 1 << 64), len(data))
            out = (total[ends] - total[starts]) * inverse[starts]
        out ^= (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


class Shard:
    """The suffix array of words given as numbers of the test vocabulary; 0 divides texts and matches nothing."""

    def __init__(self, words: np.ndarray, n_numbers: int):
        #: Zeros follow the last word.
        self.words = np.concatenate((words.astype(np.int64), np.zeros(32, np.int64)))
        n = len(words)
        #: Bits of a number; as many words as fit make a key, three as a rule.
        self.bits = max(1, int(n_numbers).bit_length())
        self.packed = 3 if self.bits <= 21 else 2
        where = np.flatnonzero(words)
        # After a 0 nothing can match, so what follows it doesn't count.
        key = self.keys(self.words, where, np.full(len(where), self.packed))
        order = np.argsort(key, kind="stable")
        self.suffixes, key = where[order], key[order]
        #: The first words of each suffix in order, which narrow a search before it begins.
        self.key = key
        # rank: place of a suffix's group of ties; 0 where no suffix begins.
        rank = np.zeros(len(self.words) + 32, np.int64)
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        group = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
        rank[self.suffixes] = group + 1
        # Suffixes that end at a 0 within their key are equal for good.
        open_ = (key & ((1 << self.bits) - 1)) != 0
        step = self.packed
        while True:
            size = np.bincount(group, minlength=len(group)) if len(group) else group
            at = np.flatnonzero(open_ & (size[group] > 1)) if len(group) else group
            if not len(at) or step > n:
                break
            ahead = rank[np.minimum(self.suffixes[at] + step, len(rank) - 1)]
            order = np.lexsort((ahead, group[at]))
            # Groups keep their places; members change theirs within the group.
            moved, ahead, own = self.suffixes[at][order], ahead[order], group[at][order]
            self.suffixes[at] = moved
            new = np.concatenate(([True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])))
            fresh = np.maximum.accumulate(np.where(new, at, 0))
            # The first of a group may stand before others of it that are not open, never after.
            group[at] = fresh
            open_[at] = ahead != 0
            rank[moved] = fresh + 1
            step *= 2

    def keys(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first words at each place as one number; zeros from a 0 or the given size on."""
        out, live = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(self.packed):
            live &= k < sizes
            w = np.where(live, words[np.minimum(at + k, len(words) - 1)], 0)
            live &= w != 0
            out = (out << self.bits) | w
        return out

    def range_of(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes lie that begin with as many of the words at each place as a key holds."""
        key = self.keys(words, at, sizes)
        missing = np.maximum(0, self.packed - sizes).astype(np.int64)
        last = key + ((np.int64(1) << (missing * self.bits)) - 1)
        return np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, last, "right")

    def _passed(self, at: np.ndarray, words: np.ndarray, start: np.ndarray, sizes: np.ndarray, after: bool) -> np.ndarray:
        """Whether the suffix at each place comes before the words there; one that begins with all of them does only for after."""
        before, live, k = np.zeros(len(at), bool), np.arange(len(at)), 0
        while live.size:
            whole = k >= sizes[live]
            before[live[whole]] = after
            live = live[~whole]
            x = self.words[np.minimum(at[live] + k, len(self.words) - 1)]
            y = words[np.minimum(start[live] + k, len(words) - 1)]
            before[live[x < y]] = True
            live = live[(x == y) & (x != 0)]
            k += 1
        return before

    def find(self, words: np.ndarray, start: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool = False) -> np.ndarray:
        """Binary search between low and high: how many suffixes come before the words at each place."""
        low, high = low.copy(), high.copy()
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) // 2
            right = self._passed(self.suffixes[middle], words, start[live], sizes[live], after)
            low[live] = np.where(right, middle + 1, low[live])
            high[live] = np.where(right, high[live], middle)
        return low

    def common(self, place: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words that the suffix at each place of the array shares with words[at:]."""
        ok = (place >= 0) & (place < len(self.suffixes))
        n, live = np.zeros(len(at), np.int64), np.flatnonzero(ok)
        while live.size:
            x = self.suffixes[place[live]] + n[live]
            y = at[live] + n[live]
            same = (x < len(self.words)) & (y < len(words))
            same[same] = (self.words[x[same]] == words[y[same]]) & (words[y[same]] != 0)
            live = live[same]
            n[live] += 1
        return n


class Tests:
    """A block of test items: their words as numbers, their own suffix array, and the distinct windows to look for."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.window, self.vocabulary, self.items = window, np.zeros(0, np.uint64), []
        hashed = []
        # In order, so that the first of equal matches is the same on each run.
        for item, text in sorted(((None if i is None else str(i), t or "") for i, t in items), key=lambda x: (x[0] is None, x[0] or "", x[1])):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends = split_words(data)
            if len(starts):
                self.items.append(item)
                hashed.append(word_hashes(data, starts, ends))
        sizes = np.array([len(h) for h in hashed], np.int64)
        words = np.concatenate(hashed) if hashed else self.vocabulary
        self.vocabulary = np.unique(words)
        ends = np.cumsum(sizes)
        ids = np.searchsorted(self.vocabulary, words) + 1
        #: The items' words one after the other, each item ended by a 0.
        words = np.insert(ids, ends, 0)
        self.starts, self.sizes = ends - sizes + np.arange(len(sizes)), sizes
        self.array = Shard(words, len(self.vocabulary) + 1)
        self.words = self.array.words
        # Distinct windows: of one length, equal ones stand side by side in the suffix array.
        suffix = self.array.suffixes
        item = np.searchsorted(self.starts, suffix, "right") - 1
        length = np.minimum(window, sizes[item]) if len(item) else item
        begins = self.starts[item] + sizes[item] - suffix >= length if len(item) else np.zeros(0, bool)
        at, n, owners, counts = [], [], [], []
        for size in np.unique(length[begins]):
            mine = np.flatnonzero(begins & (length == size))
            s = suffix[mine]
            same = np.ones(max(0, len(s) - 1), bool)
            for k in range(size):
                same &= self.words[s[1:] + k] == self.words[s[:-1] + k]
            group = np.concatenate(([0], np.cumsum(~same)))
            pairs = np.unique(np.stack([group, item[mine]], 1), axis=0)
            at.append(s[np.concatenate(([True], ~same))])
            n.append(np.full(len(at[-1]), size))
            owners.append(pairs[:, 1])
            counts.append(np.bincount(pairs[:, 0]))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        #: Where each window begins in the words, how long it is, and the items that have it.
        self.window_at, self.window_sizes, self.owners = join(at), join(n), join(owners)
        self.owner_ends = np.cumsum(join(counts))

    def owners_of(self, window: int) -> np.ndarray:
        return self.owners[(self.owner_ends[window - 1] if window else 0) : self.owner_ends[window]]


def _shards(batches: Iterator[pa.RecordBatch], tests: Tests) -> Iterator[tuple]:
    """(batch, rows, words, places of the documents, the shard)."""
    for batch in batches:
        text = batch["text"]
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in text], np.int64)
        shard = np.cumsum(sizes) // SHARD_BYTES if len(sizes) else sizes
        for s in np.unique(shard):
            rows = np.flatnonzero(shard == s)
            parts = [bytes(text[r].as_buffer()) if text[r].is_valid else b"" for r in rows]
            data = np.frombuffer(b" ".join(parts), np.uint8)
            starts, ends = split_words(data)
            hashes = word_hashes(data, starts, ends)
            known = np.minimum(np.searchsorted(tests.vocabulary, hashes), max(0, len(tests.vocabulary) - 1))
            ids = np.where(tests.vocabulary[known] == hashes, known + 1, 0) if len(tests.vocabulary) else np.zeros(len(hashes), np.int64)
            # Where each document's words begin, and a 0 between documents.
            edges = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
            places = np.searchsorted(starts, edges)
            words = np.insert(ids, places[1:-1], 0) if len(rows) > 1 else ids
            places = places + np.minimum(np.arange(len(places)), len(rows) - 1)
            places[-1] = len(words) + 1
            yield batch, rows, words, places, Shard(words, len(tests.vocabulary) + 1)


_FOUND = "n_words long, hits array<int>, items array<string>, longest long, longest_item string, item_at long, doc_at long"
_FOUND_TYPES = {
    "n_words": pa.int64(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "longest": pa.int64(), "longest_item": pa.string(), "item_at": pa.int64(), "doc_at": pa.int64(),
}


def _longest(tests: Tests, shard: Shard, where: np.ndarray, window: np.ndarray, owner: np.ndarray, places: np.ndarray) -> dict[int, tuple]:
    """Of each document with hits, the longest match that begins at one: (words, item, place in it, place in the document)."""
    if not len(where):
        return {}
    # Of the windows at one place the longest.
    order = np.lexsort((-tests.window_sizes[window], where))
    order = order[np.concatenate(([True], where[order][1:] != where[order][:-1]))]
    where, window, owner, n = where[order], window[order], owner[order], tests.window_sizes[window[order]]
    # The neighbours of a document's suffix in the tests' array share most words with it. Only an item as long
    # as a window can share more than its window.
    low, high = np.zeros(len(where), np.int64), np.full(len(where), len(tests.array.suffixes), np.int64)
    far = np.full(len(where), len(shard.words))
    near = tests.array.find(shard.words, where, far, low, high)
    common = np.maximum(tests.array.common(near - 1, shard.words, where), tests.array.common(near, shard.words, where))
    n = np.where(n >= tests.window, common, n)
    best = np.lexsort((where, -n, owner))
    best = best[np.concatenate(([True], owner[best][1:] != owner[best][:-1]))]
    where, window, owner, n = where[best], window[best], owner[best], n[best]
    a = tests.array.find(shard.words, where, n, low[best], high[best])
    b = tests.array.find(shard.words, where, n, low[best], high[best], after=True)
    out = {}
    for doc, size, x, w, lo, hi in zip(owner.tolist(), n.tolist(), where.tolist(), window.tolist(), a, b):
        if size < tests.window:
            item, at = int(tests.owners_of(w)[0]), 0
        else:
            start = int(tests.array.suffixes[lo:hi].min())
            item = int(np.searchsorted(tests.starts, start, "right")) - 1
            at = start - int(tests.starts[item])
        out[doc] = size, tests.items[item], at, x - int(places[doc])
    return out


def _marked(shared, carried: list[str], only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = shared.value
        for batch, rows, words, places, shard in _shards(batches, tests):
            low, high = shard.range_of(tests.words, tests.window_at, tests.window_sizes)
            live = np.flatnonzero(low < high)
            at, sizes, low, high = tests.window_at[live], tests.window_sizes[live], low[live], high[live]
            low, high = shard.find(tests.words, at, sizes, low, high), shard.find(tests.words, at, sizes, low, high, after=True)
            many = high - low
            window = np.repeat(live, many)
            index = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
            where = shard.suffixes[index]
            cover = np.zeros(len(words) + 2, np.int64)
            np.add.at(cover, where, 1)
            np.add.at(cover, where + tests.window_sizes[window], -1)
            hit = np.cumsum(cover) > 0
            owner = np.searchsorted(places, where, "right") - 1
            pairs = np.unique(np.stack([owner, window], 1), axis=0) if len(where) else np.zeros((0, 2), np.int64)
            items: dict[int, set] = {}
            for doc, w in pairs.tolist():
                items.setdefault(doc, set()).update(tests.owners_of(w).tolist())
            longest = _longest(tests, shard, where, window, owner, places)
            kept = [k for k in range(len(rows)) if not only_hits or k in items]
            new = {c: [] for c in _FOUND_TYPES}
            for k in kept:
                a, b = places[k], places[k + 1] - 1
                new["n_words"].append(b - a)
                new["hits"].append(np.flatnonzero(hit[a:b]).astype(np.int32))
                new["items"].append(sorted({tests.items[i] for i in items.get(k, ())}, key=lambda x: (x is None, x)))
                for c, v in zip(("longest", "longest_item", "item_at", "doc_at"), longest.get(k, (0, None, None, None))):
                    new[c].append(v)
            taken = batch.take(pa.array(rows[kept], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken[c] for c in carried), *(pa.array(new[c], t) for c, t in _FOUND_TYPES.items())], [*carried, *_FOUND_TYPES])

    return run


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> Iterator[Tests]:
    """The items with words, block by block. An item alone may exceed a block."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").filter("text IS NOT NULL").toLocalIterator():
        if block and size + len(text) > block_chars:
            yield Tests(block, window)
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield Tests(block, window)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) with n_words, hits (places of the hit words), items (sorted, as strings), and the longest match.

    The longest match of a document begins at a hit window: longest is its number of words (0 without hits),
    longest_item and item_at say where it lies in the benchmark, doc_at where in the document, places being
    counted in words from 0. Of equally long ones the first in the document counts, and there the first item.

    Words are compared by a 64-bit hash of their lower-cased bytes. A null text has no words. Items that
    have no words are not looked for; one without an identifier is, and is a null in items; items with
    equal windows are all reported. Rows that repeat a doc_id are each marked. With an empty benchmark
    nothing is hit; an empty table gives an empty result. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    row = (F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keyed = docs.select("doc_id", "text", F.xxhash64(*row).alias("_a"), F.xxhash64(F.lit(1), *row).alias("_b"))
    first, *more = (spark.sparkContext.broadcast(t) for t in _blocks(benchmark, window, block_chars))
    typed = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
    if not more:
        return docs.select("doc_id", "text").mapInArrow(_marked(first, ["doc_id"], False), typed + _FOUND)
    # Further blocks read the texts again, and only what they hit is shuffled.
    keys, columns = "_a long, _b long, ", ["doc_id", "_a", "_b"]
    found = keyed.mapInArrow(_marked(first, columns, False), typed + keys + _FOUND)
    hits = None
    for shared in more:
        part = keyed.select("_a", "_b", "text").mapInArrow(_marked(shared, ["_a", "_b"], True), keys + _FOUND).drop("n_words").dropDuplicates(["_a", "_b"])
        hits = part if hits is None else hits.unionByName(part)
    match = lambda: F.struct((-F.col("longest")).alias("n"), "doc_at", F.col("longest_item").isNull().alias("no"), "longest_item", "item_at")
    hits = hits.groupBy("_a", "_b").agg(F.flatten(F.collect_list("hits")).alias("_hits"), F.flatten(F.collect_list("items")).alias("_items"), F.min(match()).alias("_m"))
    both = found.join(hits, ["_a", "_b"], "left")
    mine = F.when(F.col("longest") > 0, match())
    best = F.coalesce(F.least(mine, "_m"), mine, F.col("_m"))
    return both.select(
        "doc_id", "n_words",
        F.sort_array(F.array_distinct(F.concat("hits", F.coalesce("_hits", F.array().cast("array<int>"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>"))))).alias("items"),
        F.coalesce(-best["n"], F.lit(0)).cast("long").alias("longest"), best["longest_item"].alias("longest_item"), best["item_at"].alias("item_at"), best["doc_at"].alias("doc_at"),
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each item's longest verbatim match: item_id (string), words, item_at, doc_id and doc_at.

    Places count words from 0. Of equally long matches the one with the smallest doc_id, doc_at and
    item_at is given; items without a match or an identifier, and documents without a doc_id, are left out.
    """
    spark, out = docs.sparkSession, None
    schema = "item_id string, words long, item_at long, doc_id long, doc_at long"
    for tests in _blocks(benchmark.filter("item_id IS NOT NULL"), WINDOW, block_chars):
        shared = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests: Tests = shared.value
            at = np.flatnonzero(tests.words)
            own = np.searchsorted(tests.starts, at, "right") - 1
            sizes = tests.starts[own] + tests.sizes[own] - at
            for batch, rows, words, places, shard in _shards(batches, tests):
                best: dict[int, tuple] = {}
                ids = batch["doc_id"]
                low, high = np.zeros(len(at), np.int64), np.full(len(at), len(shard.suffixes), np.int64)
                place = shard.find(tests.words, at, sizes, low, high)
                n = np.maximum(shard.common(place - 1, tests.words, at), shard.common(place, tests.words, at))
                # Of each item only the longest go on.
                top = np.zeros(len(tests.items), np.int64)
                np.maximum.at(top, own, n)
                live = np.flatnonzero((n == top[own]) & (n > 0))
                a = shard.find(tests.words, at[live], n[live], low[live], high[live])
                b = shard.find(tests.words, at[live], n[live], low[live], high[live], after=True)
                for k, lo, hi in zip(live.tolist(), a, b):
                    spots = shard.suffixes[lo:hi]
                    for d, x in zip((np.searchsorted(places, spots, "right") - 1).tolist(), spots.tolist()):
                        if (doc := ids[int(rows[d])].as_py()) is not None:
                            score = (-int(n[k]), doc, x - int(places[d]), int(at[k] - tests.starts[own[k]]))
                            best[own[k]] = min(best.get(own[k], score), score)
                if best:
                    found = [(tests.items[i], -s[0], s[3], s[1], s[2]) for i, s in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["item_id", "words", "item_at", "doc_id", "doc_at"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    first = F.min(F.struct((-F.col("words")).alias("n"), "doc_id", "doc_at", "item_at")).alias("m")
    return out.groupBy("item_id").agg(first).select("item_id", (-F.col("m.n")).alias("words"), "m.item_at", "m.doc_id", "m.doc_at")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit word, with the columns of docs."""
    row = (F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    keys = {"_a": F.xxhash64(*row), "_b": F.xxhash64(F.lit(1), *row)}
    shared = [docs.sparkSession.sparkContext.broadcast(t) for t in _blocks(benchmark, WINDOW, BLOCK_CHARS)]
    keyed, dirty = docs.select("text", *[c.alias(k) for k, c in keys.items()]), None
    for block in shared:
        part = keyed.mapInArrow(_marked(block, ["_a", "_b"], True), "_a long, _b long, " + _FOUND).select("_a", "_b")
        dirty = part if dirty is None else dirty.unionByName(part)
    dirty = dirty.distinct().withColumnsRenamed({"_a": "_dirty_a", "_b": "_dirty_b"})
    return docs.join(dirty, (keys["_a"] == dirty["_dirty_a"]) & (keys["_b"] == dirty["_dirty_b"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the hit words and items of every document, and its longest match."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    df = mark(docs, table(spark, sf_dir, "benchmark"))
    return df.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        "longest", "longest_item", "item_at", "doc_at",
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tests AS (
  SELECT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT item_id, text, i AS j, list_slice(w, i, i + least(10, len(w)) - 1) AS grams, least(10, len(w)) AS n
  FROM (SELECT item_id, text, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM tests WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, n, list_slice(w, i, i + n - 1) AS grams, i
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows))
), found AS (
  SELECT s.doc_id, s.i, s.n, v.item_id, v.text, v.j FROM spots s JOIN windows v ON s.grams = v.grams
), hits AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
), steps AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, text, i - j ORDER BY i) AS chain FROM found
), matches AS (
  SELECT doc_id, item_id, text, n + count(*) - 1 AS longest, min(i) - 1 AS doc_at, min(j) - 1 AS item_at FROM steps GROUP BY doc_id, item_id, text, n, i - j, chain
), best AS (
  SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, doc_at, item_id::VARCHAR NULLS LAST, text, item_at) = 1
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(b.longest, 0)::BIGINT AS longest, b.item_id::VARCHAR AS longest_item, b.item_at::BIGINT AS item_at, b.doc_at::BIGINT AS doc_at
FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id LEFT JOIN items i ON w.doc_id = i.doc_id LEFT JOIN best b ON w.doc_id = b.doc_id
"""
