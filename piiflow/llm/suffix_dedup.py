"""Suffix-array dedup: bytes of repeated 100-byte strings go, all but the first occurrence.

A suffix array of the whole corpus is never in one place. Its suffixes are dealt to shards so that equal
100-byte strings meet, and each shard sorts its own by bucket-pointer refinement.

1. Dealing. Every window of 100 bytes has a least hash among its 32-byte grams; equal windows have the
   same. Consecutive windows with the same least hash are one run, about 3 for each 100 bytes. Only the
   runs are shuffled, and only those whose hash comes up elsewhere, or twice in itself, go on; where a
   task sees a hash twice itself, one run of it stands for the others in the shuffle.
2. Segments. The bytes under the runs that are left are cut out, once for each text: exact copies of a
   document beyond the first are removed whole. Of equal segments in a batch only the first goes on.
3. Refinement. A shard puts the suffixes of its segments into buckets by their first 8 bytes, and each suffix
   points to its bucket. Buckets are then refined one group after the other, each to its end: its suffixes
   are sorted by the pointers of the suffixes 8 bytes further on, the parts get pointers of their own at once,
   and each part goes on where the bytes end that its pointers vouch for. So later steps, and later groups, read the finer
   pointers that earlier ones have left. Windows that stand side by side in the order and agree in all of
   their bytes are equal.
4. Where one hash has over HOT_SEGMENTS runs, no task gets them all: their windows go out one by one as
   segments of their own, dealt by their content and refined like the others; of equal windows in a batch only
   the first. What comes of one window fills no memory: of each part that a task takes in, the earliest of
   equal windows stays for the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import spread, written

LENGTH = 100
GRAM = 32
HOT_SEGMENTS = 5_000
HOT_BROADCAST = 500_000
SHARD_BYTES = 1_000_000
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64)
#: Odd multipliers for grams of 2, 4, ... 32 bytes.
_STEP = (np.random.default_rng(12).integers(1, 2**62, 6, np.uint64) << np.uint64(1)) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes in a row."""
    h, k = _BYTE[data], 1
    with np.errstate(over="ignore"):
        for step in _STEP:
            if k == GRAM:
                break
            h, k = h[:-k] * step + h[k:], 2 * k
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    out, k = h, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    return np.minimum(out[: len(out) - (width - k)], out[width - k :]) if k < width else out


def text_runs(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts one after the other: (text, first window, windows, least hash, whether it comes twice) of each run.

    edges: where the texts begin, and the end of the last.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    if len(data) < length:
        return empty
    h, width = gram_hashes(data), length - GRAM + 1
    least = sliding_least(h, width)
    change = np.empty(len(least) + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = least[1:] != least[:-1]
    change[edges[:-1][edges[:-1] < len(least)]] = True
    stops = edges[1:] - length + 1
    change[stops[(stops >= 0) & (stops <= len(least))]] = True
    at = np.flatnonzero(change)
    first, n = at[:-1], np.diff(at)
    text = np.searchsorted(edges, first, "right") - 1
    keep = first + length <= edges[text + 1]
    first, n, text = first[keep], n[keep], text[keep]
    value, twice = least[first], np.empty(len(first), bool)
    span = np.arange(width)
    for a in range(0, len(first), 1 << 15):
        f, v, k = first[a : a + (1 << 15)], value[a : a + (1 << 15), None], n[a : a + (1 << 15)]
        left = f + (h[f[:, None] + span] == v).argmax(1)
        end = f + k - 1 + width - 1
        right = end - (h[end[:, None] - span] == v).argmax(1)
        twice[a : a + (1 << 15)] = left < right
    return text, first - edges[text], n, value, twice


def _text_bytes(column) -> list:
    return [bytes(x.as_buffer()) if x.is_valid else b"" for x in column]


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about limit bytes together."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "t", "sn", "m"]
        for batch in batches:
            texts, ids = _text_bytes(batch["text"]), np.asarray(batch["t"])
            first = np.sort(np.unique(ids, return_index=True)[1]) if len(ids) else ids
            texts, ids = [texts[k] for k in first], ids[first]
            for a, b in _pieces(np.array([len(x) for x in texts]), 1 << 20):
                edges = np.concatenate(([0], np.cumsum([len(x) for x in texts[a:b]]))).astype(np.int64)
                text, start, n, value, twice = text_runs(np.frombuffer(b"".join(texts[a:b]), np.uint8), edges, length)
                if not len(text):
                    continue
                m, t = value.view(np.int64), ids[a:b][text]
                order = np.argsort(m, kind="stable")
                same = m[order][1:] == m[order][:-1]
                later, more = np.zeros(len(m), bool), np.zeros(len(m), bool)
                later[order[1:][same]] = True  # not the first of its hash here
                more[order[1:][same]] = more[order[:-1][same]] = True
                sn = (start << 32) | (n << 1) | (twice | more)
                spread_ = (t ^ (start * np.int64(0x9E3779B1))) * np.int64(0x2545F4914F6CDD1D)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(later, spread_, m)), pa.array(t), pa.array(sn), pa.array(m, mask=~later)], names)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key, t and sn: the runs whose hash others have, or that are marked."""
    held = None

    def emit(x: list, n: int):
        """The first n of the rows; the next one counts as a neighbour."""
        key, t, sn, m, known = x
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | ((sn[1:] | 1) != (sn[:-1] | 1))
        met = np.zeros(len(key), bool)
        same = (key[1:] == key[:-1]) & ~known[1:] & ~known[:-1]
        met[1:] |= same & fresh[1:]
        # A row with the same key as the next one that is fresh, through repeats of itself.
        group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (known[1:] != known[:-1]))))
        many = np.bincount(group, weights=fresh)[group] > 1
        marked = np.bincount(group, weights=(sn & 1) != 0)[group] > 0
        keep = fresh & (known | many | marked)
        keep[n:] = False
        if keep.any():
            k = np.flatnonzero(keep)
            out = [t[k], (sn[k] >> 32), (sn[k] & 0xFFFFFFFF) >> 1, np.where(known[k], m[k], key[k])]
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32)), pa.array(out[3])], ["t", "start", "n", "m"])

    for batch in batches:
        m = batch["m"]
        now = [np.asarray(batch[c]) for c in ("key", "t", "sn")] + [np.asarray(m.fill_null(0)), np.asarray(m.is_valid())]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        key = held[0]
        if not len(key):
            continue
        last = np.flatnonzero(key != key[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut and (out := emit([x[:cut] for x in held], cut)):
            yield out
        held = [x[cut:] for x in held]
        if len(held[0]) > 4096:
            # A long group goes out as it comes; one row stays, and says whether the group has met others.
            if (out := emit(held, len(held[0]))):
                yield out
                held[2] = held[2] | 1
            held = [x[-1:] for x in held]
    if held is not None and len(held[0]) and (out := emit(held, len(held[0]))):
        yield out


_GONE, _SEGMENT, _WINDOW = 0, 1, 2
_SEGMENTS = "kind int, key long, doc long, t long, start int, n int, data binary"


def _segments(length: int):
    """What the shards need: ranges that are known to go, segments, and windows of hot runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[tuple] = []
            first: dict[bytes, tuple] = {}

            def add(kind: int, key: int | None, piece: bytes, doc: int, t: int, start: int, n: int) -> None:
                own = (doc, t, start, n, kind, xxhash.xxh3_64_intdigest(piece) - (1 << 63) if key is None else key)
                known = first.setdefault(piece, own)
                if known[:3] == own[:3]:
                    return
                # One of the two starts earlier; the other goes, wherever else the bytes occur.
                gone = max(known, own, key=lambda x: x[:3])
                if gone is known:
                    first[piece] = own
                rows.append((_GONE, gone[0] ^ gone[1] ^ gone[2], *gone[:4], None))

            def done() -> pa.RecordBatch:
                kinds = [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
                names = [c.split()[0] for c in _SEGMENTS.split(", ")]
                out = rows + [(kind, key, doc, t, start, n, piece) for piece, (doc, t, start, n, kind, key) in first.items()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

            for doc, t, text, runs in zip(*(batch[c] for c in ("doc", "t", "text", "runs"))):
                view, doc, t = memoryview(text.as_buffer()), doc.as_py(), t.as_py()
                for r in runs.as_py():
                    start, n = r["start"], r["n"]
                    if not r["hot"]:
                        add(_SEGMENT, r["m"], bytes(view[start : start + n + length - 1]), doc, t, start, n)
                        continue
                    for a in range(start, start + n):
                        add(_WINDOW, None, bytes(view[a : a + length]), doc, t, a, 1)
                        if len(first) > 200_000:
                            yield done()
                            rows, first = [], {}
                if len(first) > 20_000:
                    yield done()
                    rows, first = [], {}
            if first:
                yield done()

    return run


def refine(data: np.ndarray, upto: int = LENGTH, group: int = 1 << 18) -> np.ndarray:
    """All suffixes in order of their first upto bytes or more: bucket-pointer refinement.

    group: how many suffixes are refined together, to their end, before the next ones read their pointers.
    """
    n, q = len(data), 8
    codes = _eights(np.concatenate((data, np.zeros(upto, np.uint8))))[:n]
    # Numbers of 32 bits do for a shard, and keep it small in memory.
    order = np.argsort(codes, kind="stable").astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    del codes
    place = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    # A bucket's pointer is the place of its first suffix, so the parts of a bucket stay in order.
    pointer = np.full(n + upto, -1, np.int32)
    pointer[order] = place
    #: How many bytes the suffixes with one pointer share at least.
    shared = np.full(n + upto, q, np.int16)
    shared[n:] = upto
    ties = np.zeros(n, bool)
    ties[1:] = ~new[1:]
    ties[:-1] |= ~new[1:]
    open_ = np.flatnonzero(ties).astype(np.int32)
    begin = 0
    while begin < len(open_):
        end = min(begin + group, len(open_))
        end = int(np.searchsorted(place[open_], place[open_[end - 1]], "right"))
        at = open_[begin:end]
        suffix, of, depth = order[at], place[at], shared[order[at]]
        while len(at):
            ahead, more = pointer[suffix + depth], shared[suffix + depth]
            by = np.lexsort((ahead, of))
            suffix, of, ahead, depth = suffix[by], of[by], ahead[by], (depth + more)[by]
            of = np.maximum.accumulate(np.where(np.concatenate(([True], (of[1:] != of[:-1]) | (ahead[1:] != ahead[:-1]))), at, np.int32(0)))
            order[at] = suffix
            pointer[suffix] = of
            shared[suffix] = np.minimum(depth, upto)
            ties = np.concatenate((of[1:] == of[:-1], [False]))
            ties[1:] |= ties[:-1].copy()
            live = ties & (depth < upto)
            at, suffix, of, depth = at[live], suffix[live], of[live], depth[live]
        begin = end
    return order


def _eights(data: np.ndarray) -> np.ndarray:
    """Every 8 bytes in a row as a number that sorts like them."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel().astype(np.uint64)


def same_windows(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of windows in suffix order, and whether each equals the one before it."""
    order = refine(data, length)
    wanted = np.zeros(len(data), bool)
    wanted[windows] = True
    order = order[wanted[order]]
    codes = _eights(data)
    live = np.arange(1, len(order))
    for k in [*range(0, length - 8, 8), length - 8]:
        live = live[codes[order[live] + k] == codes[order[live - 1] + k]]
    same = np.zeros(len(order), bool)
    same[live] = True
    return order, same


def _earlier(length: int, shard_bytes: int = SHARD_BYTES):
    columns = ("doc", "t", "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by kind and key: the windows from a to b of a document that occur earlier."""

        def made(doc, t, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc", "t", "a", "b"])

        def ranges(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
            """What occurs earlier, and which rows hold the first of some window."""
            x = {c: table[c].to_numpy().astype(np.int64) for c in columns}
            parts = [bytes(v.as_buffer()) for v in table["data"].combine_chunks()]
            # Of segments with the same bytes the first is refined; the others go whole.
            lead: dict[bytes, int] = {}
            for k in np.lexsort((x["start"], x["t"], x["doc"])).tolist():
                lead.setdefault(parts[k], k)
            kept = np.array(sorted(lead.values()))
            copies = np.ones(len(parts), bool)
            copies[kept] = False
            whole = [x[c][copies] for c in columns]
            parts, x = [parts[k] for k in kept], {c: v[kept] for c, v in x.items()}
            base = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1].astype(np.int64)
            n = x["n"]
            segment = np.repeat(np.arange(len(n), dtype=np.int32), n)
            offset = np.arange(len(segment), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
            order, same = same_windows(np.frombuffer(b"".join(parts), np.uint8), base[segment] + offset, length)
            number = np.zeros(int(base[-1]) + len(parts[-1]), np.int32)
            number[base[segment] + offset] = np.arange(len(segment), dtype=np.int32)
            order = number[order]
            s = segment[order]
            by = np.lexsort((x["start"][s] + offset[order], x["t"][s], x["doc"][s], np.cumsum(~same)))
            order = order[by]
            again = np.zeros(len(order) + 1, bool)
            again[order[same]] = True
            first = np.unique(segment[order[~same]])
            # Ranges of such windows end with their segment.
            opens = again[:-1] & (~np.concatenate(([False], again[:-2])) | (offset == 0))
            closes = again[:-1] & (~again[1:] | (offset == n[segment] - 1))
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            s = segment[a]
            columns_ = (x["doc"][s], x["t"][s], x["start"][s] + offset[a], x["start"][s] + offset[b] + 1)
            return made(*map(np.concatenate, zip(columns_, (*whole[:3], whole[2] + whole[3])))), kept[first]

        def known(table: pa.Table) -> pa.RecordBatch:
            x = {c: table[c].to_numpy().astype(np.int64) for c in columns}
            return made(x["doc"], x["t"], x["start"], x["start"] + x["n"])

        held, size = [], 0
        for batch in (b.slice(k, 2_000) for b in batches for k in range(0, b.num_rows, 2_000)):
            kind = batch["kind"].to_numpy()
            gone = int(np.searchsorted(kind, _SEGMENT))  # the lowest kind comes first
            if gone:
                yield known(pa.Table.from_batches([batch.slice(0, gone)]))
                batch = batch.slice(gone)
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < shard_bytes:
                continue
            whole = pa.Table.from_batches(held)
            key, kind = whole["key"].to_numpy(), whole["kind"].to_numpy()
            other = np.flatnonzero((key != key[-1]) | (kind != kind[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield ranges(whole.slice(0, cut))[0]
            rest = whole.slice(cut).combine_chunks()
            if kind[-1] == _WINDOW and rest.nbytes >= shard_bytes // 2:
                # Many of one window: all but the earliest are known to go.
                found, first = ranges(rest)
                yield found
                rest = rest.take(pa.array(first)).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
        if held:
            yield ranges(pa.Table.from_batches(held))[0]

    return run


def _judged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text, copy, removed in zip(*(batch[c] for c in ("doc_id", "text", "copy", "removed"))):
                data = bytes(text.as_buffer()) if text.is_valid else b""
                if copy.as_py() and len(data) >= length:
                    out.append((doc.as_py(), b"", len(data), len(data), 1))
                elif removed.is_valid:
                    cover = np.zeros(len(data) + 1, np.int64)
                    ranges = np.array([(r["a"], r["b"]) for r in removed.as_py()], np.int64)
                    np.add.at(cover, ranges[:, 0], 1)
                    np.add.at(cover, np.minimum(ranges[:, 1] + length - 1, len(data)), -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((doc.as_py(), kept, len(data), int(gone.sum()), spans))
                else:
                    out.append((doc.as_py(), data, len(data), 0, 0))
                size += len(out[-1][1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), *[pa.int64()] * 3))], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), *[pa.int64()] * 3))], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """docs(doc_id, text) as doc_id, kept (the bytes left), n_bytes, n_removed and n_spans.

    A byte goes if a length-byte string that covers it starts earlier too: in a smaller doc_id, or in the
    same document before. All is judged on the input. A null text is empty. A null doc_id comes last.
    Rows that repeat a doc_id with another text are documents next to each other, in an order of their
    texts' hashes; rows that repeat both are one document and each return it. Empty table, empty result.
    """
    if length < 64 or length > 128:
        raise ValueError("a window's least hash is looked for among its grams of 32 bytes: lengths from 64 to 128 bytes")
    last = F.lit(2**63 - 1)
    whole = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), last).alias("doc"), whole.alias("text"), F.xxhash64(whole).alias("t"))
    runs = docs.select("t", "text").mapInArrow(_runs(length), "key long, t long, sn long, m long")
    runs = runs.repartition("key").sortWithinPartitions("key", "t", "sn").mapInArrow(_met, "t long, start int, n int, m long")
    runs = written(runs)
    hot = written(runs.groupBy("m").count().filter(F.col("count") > hot_segments).select(F.col("m").alias("_hot")))
    # 8 bytes a row: a short list goes to all tasks, so that no task gets all runs of a hot hash; a longer one is joined.
    hot = F.broadcast(hot) if hot.count() <= HOT_BROADCAST else hot
    runs = runs.join(hot, runs["m"] == hot["_hot"], "left").withColumn("hot", F.col("_hot").isNotNull())
    ids = docs.select("doc", "t", F.xxhash64(F.lit(1), "text").alias("t2"))
    firsts = written(ids.groupBy("t", "t2").agg(F.min("doc").alias("first")))
    copies = ids.join(firsts, ["t", "t2"]).filter("doc > first").select(F.col("doc").alias("copy_doc"), F.col("t").alias("copy_t")).distinct().withColumn("copy", F.lit(True))
    by_text = runs.groupBy("t").agg(F.collect_list(F.struct("start", "n", "m", "hot")).alias("runs"))
    by_doc = written(by_text.join(firsts, "t").select(F.col("first").alias("of"), F.col("t").alias("of_t"), "runs"))
    # One exchange of the texts serves both joins: they ask for the same columns, dealt the same way.
    dealt = docs.repartition("doc", "t")
    cut = dealt.join(by_doc, (dealt["doc"] == by_doc["of"]) & (dealt["t"] == by_doc["of_t"])).select("doc_id", "doc", "t", "text", "runs")
    parts = cut.mapInArrow(_segments(length), _SEGMENTS)
    gone = parts.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_earlier(length), "doc long, t long, a int, b int")
    gone = gone.groupBy(F.col("doc").alias("of"), F.col("t").alias("of_t")).agg(F.collect_list(F.struct("a", "b")).alias("removed"))
    out = dealt.join(gone, (dealt["doc"] == gone["of"]) & (dealt["t"] == gone["of_t"]), "left").join(copies, (F.col("doc") == F.col("copy_doc")) & (F.col("t") == F.col("copy_t")), "left")
    return out.select("doc_id", "text", "copy", "removed").mapInArrow(_judged(length), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what is left of every document, as a digest."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
