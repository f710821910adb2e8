"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together in an order to be trained on.

A batch of texts lies in one run of UTF-8 bytes. A bitvector has a bit for each byte, set where a code point
begins; it is packed, and a directory holds the number of set bits before each block of BLOCK bytes of it. The set bits
between the ends of a text are its n code points, and a cut after some of them is the byte where the bit of
that rank lies: a search in the directory finds its block, and the block's own popcounts the bit. All texts
of a batch are cut at once; no text is decoded, and no table has an entry for each code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import spread

#: What marks the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are left plain, and of 100 others so many have the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes of the packed bitvector in a block, which stand for eight times as many bytes of text.
BLOCK = 64
#: Texts are dealt with in runs of about so many bytes.
RUN_BYTES = 8 << 20
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


class Boundaries:
    """Where code points begin in UTF-8 bytes: rank and select over a packed bitvector."""

    def __init__(self, data: np.ndarray):
        packed = np.packbits((data & 0xC0) != 0x80)
        self.packed = np.concatenate([packed, np.zeros(-len(packed) % BLOCK or BLOCK * (not len(packed)), "u1")])
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed).reshape(-1, BLOCK).sum(axis=1, dtype="i8"))])
        self.total = int(self.directory[-1])
        self.size = len(data)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many code points begin before each of some bytes."""
        at = np.asarray(at, "i8")
        byte, bit = at >> 3, at & 7
        block = byte // BLOCK
        inside = np.bitwise_count(self._block(block)).astype("i8")
        before = np.where(np.arange(BLOCK) < (byte - block * BLOCK)[:, None], inside, 0).sum(axis=1)
        last = self.packed[np.minimum(byte, len(self.packed) - 1)].astype("i8") >> (8 - bit)
        return self.directory[block] + before + np.where(bit > 0, np.bitwise_count(last), 0)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte where the code point with each of some numbers, from 0, begins; the end for the number of all."""
        rank = np.asarray(rank, "i8")
        block = np.searchsorted(self.directory, rank, "right") - 1
        upto = np.cumsum(np.bitwise_count(self._block(block)), axis=1, dtype="i8")
        left = rank - self.directory[block]
        byte = (upto <= left[:, None]).sum(axis=1)
        found = byte < BLOCK
        inner = np.minimum(byte, BLOCK - 1)
        left = left - np.where(byte > 0, upto[np.arange(len(rank)), np.maximum(byte, 1) - 1], 0)
        bits = np.unpackbits(self._block(block)[np.arange(len(rank)), inner][:, None], axis=1)
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        return np.where(found & (rank < self.total), (block * BLOCK + inner) * 8 + bit, self.size)

    def _block(self, block: np.ndarray) -> np.ndarray:
        rows = self.packed.reshape(-1, BLOCK)
        return np.where((block < len(rows))[:, None], rows[np.minimum(block, len(rows) - 1)], 0).astype("u1")


def _draws(key: str) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 that a document's key decides."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def _formed(plain_percent: int, suffix_first_percent: int):
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run_of(texts: list[bytes], keys: list) -> tuple[list, ...]:
        data = np.frombuffer(b"".join(texts), "u1")
        ends = np.cumsum([len(t) for t in texts], dtype="i8")
        begins = ends - [len(t) for t in texts]
        bits = Boundaries(data)
        first = bits.rank(begins)
        n = bits.rank(ends) - first
        h = np.array([_draws(f"1:{'' if k is None else k}") for k in keys], "i8").reshape(-1, 4)
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        low, high = np.minimum(one, two), np.maximum(one, two)
        # The end of a text is where the next one begins.
        cuts = [np.minimum(bits.select(first + cut), ends) - begins for cut in (low, high)]
        out = ([], [], [], [])
        for k, text in enumerate(texts):
            if not text or h[k, 2] % 100 >= 100 - plain_percent or p in text or s in text or m in text:
                row = ("plain", None, None, text)
            else:
                a, b = int(cuts[0][k]), int(cuts[1][k])
                before, middle, after = text[:a], text[a:b], text[b:]
                spm = h[k, 3] % 100 < suffix_first_percent
                parts = (s, after, p, before, m, middle) if spm else (p, before, s, after, m, middle)
                row = ("spm" if spm else "psm", int(low[k]), int(high[k] - low[k]), b"".join(parts))
            for column, value in zip(out, row):
                column.append(value)
        return n.tolist(), *out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, begin, size = batch["doc_id"].to_pylist(), [], 0, 0
            for k, text in enumerate(batch["text"].cast(pa.binary())):
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size < RUN_BYTES and k < batch.num_rows - 1:
                    continue
                some = ids[begin : k + 1]
                n, form, before, middle, output = run_of(texts, some)
                longs = [pa.array(c, pa.int64()) for c in (some, n, before, middle)]
                output = pa.array(output, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*longs[:2], pa.array(form, pa.string()), *longs[2:], output], COLUMNS)
                texts, begin, size = [], k + 1, 0

    return run


def transform(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """docs(doc_id, text) as doc_id, n (code points), form, prefix_chars, middle_chars and output.

    A digest of the doc_id decides cuts and form, so that rows with one doc_id and text are alike; a null doc_id counts as an empty one.
    A null text is empty. Empty texts, and such that hold a mark, are plain whatever is drawn: their output is the
    text, and their cuts are null. A part may be empty. Other columns are left out, whatever they are
    called. Each row stands for itself, and an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_formed(plain_percent, suffix_first_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: parts hold no mark, so the first mark of a kind ends the part before it."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.length(one) + len(first) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    before, after, middle = parts(PREFIX, SUFFIX)
    after2, before2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(before, middle, after)).when(form == "spm", F.concat(before2, middle2, after2)).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: how every document is formed, and digests of its output and of the text read back from that."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    formed = transform(docs)
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM drawn
), cut AS (
  SELECT doc_id, t, n, least(one, two) AS a, greatest(one, two) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
