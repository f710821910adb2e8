import os
import random

import pytest
import regex

from piiflow.llm import token_counts as T


def greedy(word, first, rest):
    n, at, pieces = 0, 0, first
    while at < len(word):
        to = next((k for k in range(len(word), at, -1) if word[at:k] in pieces), None)
        if to is None:
            return -1
        n, at, pieces = n + 1, to, rest
    return n


@pytest.mark.parametrize("seed", range(40))
def test_automaton_counts_as_greedy_matching_does(seed):
    rng = random.Random(seed)
    draw = lambda: tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6)))
    first, rest = {draw() for _ in range(rng.randrange(1, 12))}, {draw() for _ in range(rng.randrange(1, 12))}
    automaton = T.Automaton(first, rest)
    for _ in range(300):
        word = tuple(rng.randrange(3) for _ in range(rng.randrange(0, 14)))
        assert automaton.count(word) == greedy(word, first, rest), (word, first, rest)


def test_long_words_take_linear_time():
    automaton = T.Automaton([(0,) * k for k in (1, 2, 50)] + [(0,) * 60 + (1,)], [(0,), (0,) * 50])
    assert automaton.count((0,) * 1_000_000) == 20_000


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")
def test_texts_against_greedy_matching(spark):
    pieces = T.byte_pieces()
    known = set(pieces)
    texts = ["The cat's 42 re-runs!!", "", None, "  \n\t ", "naïve café Ünïcode 漢字 é", "x" * 500, "a b", "I'LL see"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in T.count_tokens(docs, pieces).collect()}
    assert len(got) == len(texts)
    import unicodedata

    for k, text in enumerate(texts):
        n = 0
        for w in (text or "").split():
            for part in regex.findall(T.PARTS, unicodedata.normalize("NFC", w).lower()):
                n += greedy((*part.encode(), T.END), known, known)
        assert (got[k].n_words, got[k].n_tokens, got[k].n_unknown) == (len((text or "").split()), n, 0)


def test_unknown_parts_and_empty_tables(spark):
    pieces = [(ord("a"),), (ord("b"), T.END)]
    docs = spark.createDataFrame([(1, "ab aab zz b"), (None, "ab"), (1, "ab aab zz b")], "doc_id long, text string")
    got = sorted(map(tuple, T.count_tokens(docs, pieces).collect()), key=str)
    assert got == sorted([(1, 4, 7, 1), (None, 1, 2, 0), (1, 4, 7, 1)], key=str)
    assert T.count_tokens(docs.limit(0), pieces).count() == 0
    clash = docs.selectExpr("*", "7 AS n_words", "'x' AS n_tokens", "text AS n_unknown")
    assert sorted(map(tuple, T.count_tokens(clash, pieces).collect()), key=str) == got


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")
def test_words_that_end_within_a_piece(spark):
    """The longest piece at the end of these has no end mark."""
    pieces = T.byte_pieces()
    # Written out: a piece that reaches the last byte must have the mark, which is no symbol of its own.
    inner, last = {p for p in pieces if p[-1] != T.END}, {p[:-1] for p in pieces if p[-1] == T.END}

    longest = max(map(len, inner | last))

    def plain(part):
        word, at, n = tuple(part.encode()), 0, 0
        while at < len(word):
            at = next(k for k in range(min(len(word), at + longest), at, -1) if word[at:k] in (last if k == len(word) else inner))
            n += 1
        return n

    words = ["f\u00fcr", "thre", "ci\u00f3n\u00f1", "x" * 500 + "wor", "wor" * 20_000]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in T.count_tokens(docs, pieces).collect()}
    assert got == {k: (1, plain(w), 0) for k, w in enumerate(words)}
    assert all(got[k][1] > 1 for k in got)
