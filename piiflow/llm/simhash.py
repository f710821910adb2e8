"""SimHash near-dedup: 64-bit fingerprints, vantage-point trees, and the components of their links.

Two fingerprints link if at most RADIUS = 3 of their bits differ. One vantage point for all 64 bits
prunes little, since the distances of unrelated fingerprints crowd around 32. So there are two
trees, one for each half of the bits: of 3 differing bits one half has at most 1. In a tree each level
looks at the next few bits of its half and has a vantage point: one of the fingerprints themselves, of a
bounded sample the one whose distances on these bits part the sample most evenly. It parts the
fingerprints into rings of equal Hamming distance to it. The levels' bits are disjoint, so the triangle bounds of the
levels add up: two fingerprints whose half differs in one bit lie in rings that differ by one on one
level and agree on all others. A leaf is a path of rings and is one shard. A fingerprint lies in its own
leaf, and visits the leaves one ring further out on one level, where the bound can't exclude a partner;
the visits in the other direction are those partners' own. All pairs within a leaf are then compared
exactly on all 64 bits, and only a forest of the links that were found leaves it. The number of levels grows with the
logarithm of the number of fingerprints, so a leaf stays small; a leaf over LEAF_ROWS is cut into
chunks, and each pair of chunks is a task of its own.

Copies share one fingerprint and go through the trees once. Components come from rounds of large and
small stars over the links of fingerprints, written to the shared folder between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import release, spread, written

RADIUS = 3
SHINGLE = 3
LEAF_ROWS = 50_000
#: Vantage points are chosen among so many fingerprints, those first by a hash. The links don't depend on them.
SAMPLE_ROWS = 1_000


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        xxh64, step = xxhash.xxh64_intdigest, 1 << 16

        def fingerprint(text: str | None) -> int:
            words = text.encode().lower().split() if text else []  # both know ASCII only
            if not words:
                return 0
            if len(words) < shingle:
                return xxh64(b" ".join(words), 42)
            whole, n = b" ".join(words), len(words) - shingle + 1
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            counts = np.zeros(64, np.int64)
            for at in range(0, n, step):
                to = min(n, at + step)
                hashes = [xxh64(whole[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())]
                counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")

        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"), pa.array(found)], [*(n for n in batch.schema.names if n != "text"), "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) as doc_id and the 64-bit fp, with the long columns carried between them.

    A bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the shingles, repeats included.
    Fewer words than a shingle are one shingle; none, or a null text, give 0.
    """
    schema = ", ".join(f"`{c}` long" for c in ("doc_id", *carried, "fp"))
    return docs.select(F.col("doc_id").cast("long"), *carried, "text").mapInArrow(_fingerprints(shingle), schema)


def _leaves(n: int) -> tuple[int, int]:
    """Bits a level and the number of levels for n fingerprints: about 8 in a leaf, as far as the bits go."""
    for bits, ring_bits in ((4, 2.03), (2, 1.5)):
        for levels in range(3, 32 // bits + 1):
            if n <= 8 * 2 ** (ring_bits * levels):
                return bits, levels
    return 2, 16


def vantage_points(fps: DataFrame, half: int, bits: int, levels: int, sample_rows: int = SAMPLE_ROWS) -> list[int]:
    """For each level of a tree the sampled fingerprint whose rings on the level's bits are most even."""
    order = F.xxhash64(F.lit(half), "fp")
    sample = [r.fp & (1 << 64) - 1 for r in fps.select("fp", order.alias("o")).orderBy("o", "fp").limit(sample_rows).collect()]
    points = []
    for level in range(levels):
        shift, mask = 32 * half + bits * level, (1 << bits) - 1
        seen: dict[int, int] = {}
        for fp in sample:
            seen[fp >> shift & mask] = seen.get(fp >> shift & mask, 0) + 1

        def unevenness(fp: int) -> int:
            rings = [0] * (bits + 1)
            for x, n in seen.items():
                rings[(x ^ fp >> shift & mask).bit_count()] += n
            return sum(n * n for n in rings)

        # Points that look alike on these bits have the same rings.
        best = {fp >> shift & mask: fp for fp in reversed(sample)}
        points.append(min(best.values(), key=lambda fp: (unevenness(fp), fp), default=0))
    return points


def leaves(fps: DataFrame, n: int) -> DataFrame:
    """fps(fp) as (leaf, fp): each fingerprint's own leaf and those it visits, in both trees."""
    bits, levels = _leaves(n)

    def tree(half: int) -> Column:
        rings = []
        for level, point in enumerate(vantage_points(fps, half, bits, levels)):
            shift = 32 * half + bits * level
            seen = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
            rings.append(F.bit_count(seen.bitwiseXOR(F.lit((point >> shift) & ((1 << bits) - 1)))).cast("long"))
        own = F.lit(half).cast("long")
        for level, ring in enumerate(rings):
            own = own + ring * F.lit(2 * (bits + 1) ** level)
        visits = [F.when(ring < bits, own + F.lit(2 * (bits + 1) ** level)) for level, ring in enumerate(rings)]
        return F.array(own, *visits)

    found = F.explode(F.concat(tree(0), tree(1)))
    return fps.select("fp", found.alias("leaf")).filter("leaf IS NOT NULL")


def _chunks(entries: DataFrame, leaf_rows: int) -> DataFrame:
    """entries(leaf, fp) with a part: each pair of chunks of a large leaf, 0 for all others."""
    large = entries.groupBy("leaf").count().filter(F.col("count") > leaf_rows).select("leaf", F.ceil(F.col("count") / leaf_rows).cast("int").alias("chunks"))
    entries = entries.join(large, "leaf", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(own, k) * F.col("chunks") + F.greatest(own, k))
    return entries.select("leaf", F.explode(F.coalesce(pairs, F.array(F.lit(0)))).alias("part"), "fp")


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by leaf and part: for every such group a forest of its links."""
        import numpy as np

        names, small = ["a", "b"], 64

        def near(x, y):
            return np.bitwise_count(x ^ y) <= radius

        def forest(fps) -> list:
            """Breadth first: each member looks at all that are not reached yet."""
            out, rest = [], np.unique(fps)
            while len(rest) > 1:
                frontier, rest = [rest[0]], rest[1:]
                while frontier and len(rest):
                    x = frontier.pop()
                    hit = near(x, rest)
                    if hit.any():
                        new = rest[hit]
                        out.append(np.stack([np.full(len(new), x), new], 1))
                        frontier.extend(new)
                        rest = rest[~hit]
            return out

        def edges(leaf, part, fps) -> list:
            out = []
            starts = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]))))
            sizes = np.diff(np.concatenate((starts, [len(leaf)])))
            for s, k in zip(starts[sizes > small], sizes[sizes > small]):
                out += forest(fps[s : s + k])
            group = np.repeat(np.arange(len(starts)), sizes)
            keep = np.repeat(sizes <= small, sizes)
            group, fps = group[keep], fps[keep]
            for shift in range(1, int(sizes[sizes <= small].max(initial=1))):
                x, y = fps[:-shift], fps[shift:]
                hit = (group[:-shift] == group[shift:]) & near(x, y) & (x != y)
                if hit.any():
                    out.append(np.stack([x[hit], y[hit]], 1))
            return out

        held = None
        for batch in batches:
            now = [np.asarray(batch[c]) for c in ("leaf", "part", "fp")]
            now[2] = now[2].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if not len(held[0]):
                continue
            # The last group may go on in the next batch.
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            found, held = edges(*[x[:cut] for x in held]) if cut else [], [x[cut:] for x in held]
            if found:
                pairs = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)
        if held is not None and len(held[0]) and (found := edges(*held)):
            pairs = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)

    return run


def links(fps: DataFrame, n: int, radius: int = RADIUS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Of n distinct fingerprints fps(fp), pairs (a, b) that connect just what the links connect."""
    if not 0 <= radius <= 3:
        raise ValueError("two trees with one visited ring find links of 3 bits at most")
    parts = _chunks(leaves(fps, n), leaf_rows)
    parts = parts.repartition("leaf", "part").sortWithinPartitions("leaf", "part")
    return parts.mapInArrow(_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) as (node, root): the smallest node of each node's component, roots included.

    Large stars link larger neighbours to the smallest one, small stars the others; they take turns
    until nothing changes, which is in about the logarithm of a component's size.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        # Large star: both directions; neighbours larger than the node go to the smallest of all.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        before, edges = edges, written(small)
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    named = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    release(edges)
    return named


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, carried: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) as doc_id, the long columns carried, fp, component_id and component.

    component_id is the smallest doc_id that links reach, component the smallest fingerprint.

    Documents without words have fingerprint 0 and link like any other. Rows that repeat a doc_id are
    each fingerprinted, and return a row each. A null doc_id gets a component but never names one,
    unless it is alone. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs, shingle, carried))
    groups = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = written(links(groups.select("fp"), groups.count(), radius))
    reached = components(found)
    release(found)
    # Of each fingerprint in a component, the smallest document of all of them.
    linked = groups.join(reached, groups["fp"] == reached["node"])
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(smallest, "root").select(F.col("fp").alias("_fp"), F.col("component_id").alias("_linked"), "root")
    named = groups.join(linked, groups["fp"] == linked["_fp"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("_linked", "first").alias("component_id"), F.coalesce("root", "fp").alias("component")
    )
    named = written(named)
    return marked.join(named, marked["fp"] == named["_fp"]).select("doc_id", *carried, "fp", "component_id", "component")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprint and component of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with the columns of docs.

    Rows that repeat both doc_id and text are one document and stay together; of those that repeat only the
    doc_id one of each component stays. Documents without a doc_id are told apart by their texts and come after all
    others: one stays where its component has no document with a doc_id.
    """
    row = (F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    a, b = F.xxhash64(*row), F.xxhash64(F.lit(1), *row)
    found = near_duplicates(docs.select("doc_id", "text", a.alias("_a"), b.alias("_b")), carried=("_a", "_b"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_a", "_b"))
    kept = found.groupBy("component").agg(first.alias("_first")).select(F.col("_first._a").alias("_kept_a"), F.col("_first._b").alias("_kept_b"))
    return docs.join(kept, (a == kept["_kept_a"]) & (b == kept["_kept_b"]), "left_semi")
