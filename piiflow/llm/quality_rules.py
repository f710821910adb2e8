"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule looks at a document and votes good (1), bad (-1) or abstains (0). How far a rule can be
trusted is not given: expectation-maximisation estimates every rule's accuracy from how the votes of
all documents agree. A document's posterior probability of being good then weighs its votes, so one
unreliable rule can't reject it and one reliable rule can. Columns are built from SQL functions only.
What reaches the driver is one count for each combination of votes: at most 3 to the power of the
number of rules, however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import SPACE, WORD, held, spread, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules read.

    A null text counts as one without words. Windows of words are compared by 64-bit hashes within one
    document; all other counts are of the text itself.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    df = held(
        docs,
        _words=F.filter(F.split(whole, SPACE + "+", -1), lambda w: w != ""),
        _lines=lines,
        n_symbols=F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        n_upper=F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"),
        n_ends=F.regexp_count(whole, F.lit(r"[.?!]+(?=[\x20\x09-\x0D]|\z)")).cast("long"),
        n_shouts=F.regexp_count(whole, F.lit(r"[!?]{2,}")).cast("long"),
    )
    df = held(df, _hashes=F.transform("_words", lambda w: F.xxhash64(w)))
    df = held(
        df,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_distinct_words=F.size(F.array_distinct("_hashes")).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_stutters=F.size(F.filter("_hashes", lambda h, i: h == F.get("_hashes", i - 1))).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    )
    # A repeated window repeats its five runs of four words; most documents have fewer of those and stop here.
    df = held(df, _fours=_runs(4))
    df = held(df, _windows=F.when(F.size("_fours") - F.size(F.array_distinct("_fours")) > WINDOW - 4, _runs(WINDOW)))
    # Sorting brings equal windows together; documents without any skip it.
    df = held(
        df,
        _sorted=F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )

    def again(x: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
        return F.when(same(j - 1) | same(j + 1), x["i"])

    df = held(df, _starts=F.sort_array(F.filter(F.transform("_sorted", again), lambda i: i.isNotNull())))
    fresh = F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    return df.drop("_words", "_lines", "_hashes", "_fours", "_windows", "_sorted", "_starts")


def _runs(k: int) -> Column:
    """A hash of every k consecutive words."""
    return F.when(
        F.col("n_words") >= k,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - k).cast("int")), lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The default rules over features(): votes of 1, -1 or 0."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    symbols, upper, shouts = per("n_symbols", "word_chars"), per("n_upper", "word_chars"), per("n_shouts", "n_words")
    repeats, variety, copies = per("n_repeat_words", "n_words"), per("n_distinct_words", "n_words"), per("n_dup_lines", "n_lines")
    stutter = per("n_stutters", "n_words")
    length, sentence = per("word_chars", "n_words"), per("n_words", "n_ends")
    vote = lambda bad, good=F.lit(False): F.when(bad, -1).when(good, 1).otherwise(0)
    plain = (symbols < 0.01) & (upper < 0.2) & (shouts < 0.02) & (stutter < 0.2)
    return {
        "symbols": vote(symbols > 0.05),
        "capitals": vote(upper > 0.5),
        "shouting": vote(shouts > 0.2),
        "repeated_windows": vote(repeats > 0.3),
        "few_distinct_words": vote((variety < 0.2) & (F.col("n_words") < 2000) | (variety < 0.05)),
        "stutter": vote(stutter > 0.3),
        "repeated_lines": vote((copies > 0.5) & (F.col("n_lines") >= 4)),
        "word_length": vote((length < 2) | (length > 15)),
        "sentences": vote(F.lit(False), plain & sentence.between(2, 60)),
        "varied": vote(F.lit(False), plain & (variety > 0.3) & (repeats < 0.1)),
        "long_enough": vote(F.col("n_words") < 10, plain & (F.col("n_words") >= 40) & (repeats < 0.1)),
    }


def estimate(counts: Iterable[tuple[tuple[int, ...], int]], n_rules: int, balance: float = 0.5, rounds: int = 50) -> list[float]:
    """Each rule's accuracy where it votes, by EM over the counts of vote combinations.

    A Beta(8, 2) prior holds a rule near 0.8 until its votes meet those of others; accuracies stay
    between 0.55 and 0.99, as a rule is better than chance by construction.
    """
    counts = sorted(counts)
    accuracy = [0.8] * n_rules
    for _ in range(rounds):
        right, voted = [8.0] * n_rules, [10.0] * n_rules
        for votes, n in counts:
            good = posterior(votes, accuracy, balance)
            for j, v in enumerate(votes):
                if v:
                    right[j] += n * (good if v > 0 else 1 - good)
                    voted[j] += n
        new = [min(0.99, max(0.55, r / v)) for r, v in zip(right, voted)]
        if max((abs(a - b) for a, b in zip(new, accuracy)), default=0) < 1e-9:
            return new
        accuracy = new
    return accuracy


def weight(accuracy: float) -> float:
    return math.log(accuracy / (1 - accuracy))


def posterior(votes: tuple[int, ...], accuracy: list[float], balance: float = 0.5) -> float:
    """The probability of a good document, given its votes."""
    score = weight(balance) + sum(v * weight(a) for v, a in zip(votes, accuracy))
    return 1 / (1 + math.exp(-score))


def judge(docs: DataFrame, text: str = "text", balance: float = 0.5, keep_from: float = 0.5, own_rules: dict[str, Column] | None = None) -> DataFrame:
    """docs, without the text, with features(), base_failed, quality (the posterior) and kept.

    kept: not base_failed, and quality is keep_from or more. Each row is judged by itself, also where
    rows or identifiers repeat; columns of docs that clash with one of the new names are replaced. An
    empty table gives an empty result. Identical runs give identical results.
    """
    used = rules() if own_rules is None else own_rules
    new = ("word_chars", "n_symbols", "n_upper", "n_ends", "n_shouts", "n_stutters", "n_words", "n_distinct_words", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new and c != text])
    measured = features(docs, text).drop(text)
    measured = written(measured.withColumns({f"_vote_{k}": v for k, v in used.items()}))
    votes = [f"_vote_{k}" for k in used]
    rows = measured.groupBy(votes).count().collect()  # at most 3 ** len(used)
    accuracy = estimate([(tuple(r[:-1]), r[-1]) for r in rows], len(votes), balance)
    score = F.lit(weight(balance))
    for name, a in zip(votes, accuracy):
        score = score + F.col(name) * F.lit(weight(a))
    return measured.withColumns({"base_failed": base_failed(), "quality": 1 / (1 + F.exp(-score))}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= keep_from - 1e-9)
    ).drop(*votes)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the counts and the verdict for every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs."""
    # The verdict joins by identifier and content, so rows of one identifier with other texts keep their own verdict.
    key = F.xxhash64("text")
    good = judge(docs.select("doc_id", "text", key.alias("_key"))).filter("kept").select(F.col("doc_id").alias("_id"), "_key").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["_id"]) & (key == good["_key"]), "left_semi")
