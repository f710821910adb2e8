"""Token counts: greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie. Every node also has a failure link, to the node where matching goes on once
the pieces that are certain by then are taken off, and the number of these pieces. So a word is read
once, symbol by symbol, and the number of its longest-match pieces is summed up on the way; no piece is
ever built and no symbol read twice, however long the word is.

Words recur, so each task keeps the counts of short words it has seen, up to CACHED of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import spread

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CACHED = 300_000
#: The parts of a word, in its lower-case form: fixed values of the tokenizer's file.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = 256


class Automaton:
    """Longest-match piece counts of symbol sequences (whole numbers below 512).

    first: pieces that may begin a word; rest: those that may follow another piece. Node 0 begins a
    word, node 1 comes after a piece; link -1 says that no pieces fit.
    """

    def __init__(self, first: Iterable[tuple[int, ...]], rest: Iterable[tuple[int, ...]]):
        self.next: dict[int, int] = {}
        parent, symbol, ends, depth = [-1, -1], [0, 0], [False, False], [0, 0]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for s in piece:
                    child = self.next.get(node << 9 | s)
                    if child is None:
                        child = self.next[node << 9 | s] = len(parent)
                        parent.append(node)
                        symbol.append(s)
                        ends.append(False)
                        depth.append(depth[node] + 1)
                    node = child
                if node > 1:
                    ends[node] = True
        self.link, self.popped = [-1] * len(parent), [0] * len(parent)
        for node in sorted(range(2, len(parent)), key=depth.__getitem__):
            if ends[node]:
                self.link[node], self.popped[node] = 1, 1
                continue
            at, n = self.link[parent[node]], self.popped[parent[node]]
            while at >= 0 and (to := self.next.get(at << 9 | symbol[node])) is None:
                n += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = to, n

    def count(self, word: Iterable[int]) -> int:
        """Pieces of a word, or -1 if it has symbols left that no pieces fit."""
        step, link, popped = self.next.get, self.link, self.popped
        node, n = 0, 0
        for s in word:
            while (to := step(node << 9 | s)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return -1
            node = to
        while node > 1:
            n += popped[node]
            node = link[node]
        return n if node >= 0 else -1


def byte_pieces(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary with word ends, as bytes and END."""
    with open(path) as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    # Byte-level files write bytes that don't print as characters from 256 on, in their order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    pieces = []
    for piece in model["vocab"]:
        ended = bool(end) and piece.endswith(end) and piece != end
        stem = piece.removesuffix(end) if ended else piece
        if all(c in byte for c in stem):
            pieces.append(tuple(byte[c] for c in stem) + (END,) * ended)
    return pieces


def folded(piece: tuple[int, ...]) -> tuple[int, ...]:
    """A piece whose END is made part of the symbol before it, so that no piece stops between the two."""
    return (*piece[:-2], piece[-2] + END) if len(piece) > 1 and piece[-1] == END else piece


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        import numpy as np
        import regex

        automaton, parts = shared.value, regex.compile(PARTS).finditer

        def pieces(word: str) -> tuple[int, int]:
            n = unknown = 0
            for part in parts(unicodedata.normalize("NFC", word).lower()):
                k = automaton.count(folded((*part[0].encode(), END)))
                n, unknown = n + max(k, 1), unknown + (k < 0)
            return n, unknown

        class Seen(dict):
            def __missing__(self, word: str) -> int:
                n, unknown = pieces(word)
                # One number for both; a text has fewer than 2 ** 32 tokens.
                found = n << 32 | unknown
                if len(word) <= 64:
                    if len(self) >= CACHED:
                        self.clear()
                    self[word] = found
                return found

        seen = Seen()
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(batch["text"]):
                if text.is_valid and (words := text.as_py().split()):
                    both = sum(map(seen.__getitem__, words))
                    out[k] = len(words), both >> 32, both & 0xFFFFFFFF
            names = ["n_words", "n_tokens", "n_unknown"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(np.ascontiguousarray(out[:, j])) for j in range(3))], ["doc_id", *names])

    return run


def count_tokens(docs: DataFrame, pieces: Iterable[tuple[int, ...]]) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_words, n_tokens and n_unknown.

    Words lie between Unicode white space; each is composed (NFC), lower-cased and cut into PARTS, and
    each part with its end mark into the longest pieces from its start on; the mark is part of the last
    symbol, which only pieces with the mark fit. A part that no pieces fit is one unknown token. A null or empty text has no words. Each row is counted by itself; an empty table
    gives an empty result. The vocabulary is broadcast: its size is the tokenizer's, not the corpus's.
    """
    pieces = [folded(p) for p in pieces]
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces, pieces))
    return docs.select("doc_id", "text").mapInArrow(_counts(shared), "doc_id long, n_words long, n_tokens long, n_unknown long")


def query(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """op10: words and tokens of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text"))
    return count_tokens(docs, byte_pieces(vocabulary))
