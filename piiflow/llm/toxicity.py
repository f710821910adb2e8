"""Toxicity: two class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood.

A word is drawn in steps: its first letters, the next ones, and so on to the whole word; its beginnings are the contexts (expressions).
For each class, the model of a step is the discounted share of an expression among those that go on from the same
beginning, in documents of the class, and what the discount frees goes to a backoff that both classes share:
Kneser-Ney continuation counts, in how many classes an expression is found, not how often. So an expression
that one class lacks is priced by the same backoff in both, and one that neither has, by nothing else.

A step's log ratio counts only as far as it exceeds what chance (MARGIN standard errors of its two counts) and drift (SLACK,
as where the classes' languages differ a little) explain. The steps with anything left are the model's telling expressions. A text's score is
the sum of its words' steps over its number of words; a logistic curve, fitted on labelled documents that
no count has seen, makes it a probability.

Counting reduces in each task before it is shuffled; the table of expressions grows with the labelled corpus
and is never collected. Telling expressions, of which there are few, go to all tasks up to SENT of them, the
most common first; those beyond are joined to the documents' words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import spread, written

#: Letters after which a word's beginning is an expression.
STEPS = (2, 3, 4, 6)
MARGIN, SLACK = 2.0, 1.0
#: Telling expressions that are sent to all tasks.
SENT = 200_000
#: A bounded sample: labelled documents for the curve, those with the least hashes.
CURVE_ROWS = 20_000
FOLDS, HELD_OUT, CURVE_PART = 3, 1, 4
THRESHOLD = 0.7
#: A task hands on its counts when it holds so many expressions.
HELD = 300_000
#: A word beyond so many letters is named by these and a digest.
LONG = 64


def expressions(word: str) -> tuple[str, ...]:
    """The steps of a word: its beginnings, and all of it with an end mark."""
    import xxhash

    whole = word if len(word) <= LONG else f"{word[:LONG]}#{xxhash.xxh3_128_hexdigest(word)}"
    return (*[word[:k] for k in STEPS if k < len(word)], whole + "$")


def _words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\W\d_]+", (text or "").lower())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each class expressions are found."""
    known: dict[str, tuple] = {}
    counts: tuple[dict, dict] = ({}, {})

    def table() -> pa.RecordBatch:
        found = list(counts[0].keys() | counts[1].keys())
        n0, n1 = ([c.get(e, 0) for e in found] for c in counts)
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], ["expression", "n0", "n1"])

    for batch in batches:
        for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"]):
            here: set[str] = set()
            for w in set(_words(text.as_py())):
                if w not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[w] = expressions(w)
                here.update(known[w])
            own = counts[1 if toxic else 0]
            for e in here:
                own[e] = own.get(e, 0) + 1
            if len(counts[0]) + len(counts[1]) > HELD:
                yield table()
    if counts[0] or counts[1]:
        yield table()


def _parent(expression: Column) -> Column:
    """What an expression goes on from: its longest beginning that is a step, or nothing."""
    letters = F.length(expression) - F.when(expression.endswith("$"), 1).otherwise(0)
    upto = F.lit(0)
    for k in STEPS:
        upto = F.when(letters > k, k).otherwise(upto)
    return F.substr(expression, F.lit(1), upto)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def telling(labelled: DataFrame, margin: float = MARGIN, slack: float = SLACK) -> DataFrame:
    """labelled(toxic, text) as (expression, n0, n1, step): expressions whose log ratio of the classes tells something."""
    counts = labelled.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(_held, "expression string, n0 long, n1 long")
    counts = written(counts.groupBy("expression").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("parent", _parent(F.col("expression"))))
    # Discounts by the share of expressions that one document has: n1 / (n1 + 2 n2).
    exactly = lambda c, k: F.count(F.when(F.col(c) == k, 1))
    shares = counts.agg(*[F.try_divide(exactly(c, 1), exactly(c, 1) + 2 * exactly(c, 2)).alias(c) for c in ("n0", "n1")]).first()
    discounts = [min(0.95, max(0.1, d if d is not None else 0.75)) for d in shares]
    there = lambda c: (F.col(c) > 0).cast("long")
    parents = counts.groupBy("parent").agg(
        F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.sum(there("n0")).alias("kinds0"), F.sum(there("n1")).alias("kinds1"), F.sum(there("n0") + there("n1")).alias("kinds")
    )
    steps = counts.join(parents, "parent")
    backoff = (there("n0") + there("n1")) / F.col("kinds")

    def p(k: int) -> Column:
        own = F.greatest(F.col(f"n{k}") - F.lit(discounts[k]), F.lit(0.0)) + F.lit(discounts[k]) * F.col(f"kinds{k}") * backoff
        return F.coalesce(F.try_divide(own, F.col(f"all{k}")), backoff)

    ratio = F.log(p(1)) - F.log(p(0))
    error = F.lit(slack) + F.lit(margin) * F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    step = F.signum(ratio) * F.greatest(F.abs(ratio) - error, F.lit(0.0))
    return written(steps.select("expression", "n0", "n1", step.alias("step")).filter("step <> 0"))


def _sums(sent: dict[str, float], rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            sums, words, others = [], [], []
            for text in batch["text"]:
                found = _words(text.as_py())
                total, missing = 0.0, {}
                for w in found:
                    at = known.get(w)
                    if at is None or rest:
                        own = expressions(w)
                        at = sum(sent.get(e, 0.0) for e in own)
                        if len(known) > HELD:
                            known.clear()
                        known[w] = at
                        if rest:
                            for e in own:
                                if e not in sent:
                                    missing[e] = missing.get(e, 0) + 1
                    total += at
                sums.append(total)
                words.append(len(found))
                others.append(list(missing.items()))
            other = pa.array(others, pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(sums, pa.float64()), pa.array(words, pa.int64()), other], ["row", "doc_id", "total", "n_words", "others"])

    return run


def log_ratios(docs: DataFrame, model: DataFrame, sent: int = SENT) -> DataFrame:
    """docs(doc_id, text) as doc_id and ratio: the mean of the words' log ratios, 0 where there are no words."""
    first = model.orderBy(F.desc(F.col("n0") + F.col("n1")), "expression").limit(sent + 1).collect()
    rest = len(first) > sent
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    some = {r.expression: r.step for r in first[:sent]}
    summed = rows.mapInArrow(_sums(some, rest), "row long, doc_id long, total double, n_words long, others map<string,long>")
    total = F.col("total")
    if rest:
        # What was not sent: rows that are alike have the same words, and are told apart by nothing.
        summed = written(summed)
        words = summed.select("row", F.explode("others").alias("expression", "k")).groupBy("row", "expression").agg(F.max("k").alias("k"))
        more = words.join(model.select("expression", "step"), "expression").groupBy("row").agg(F.sum(F.col("k") * F.col("step")).alias("more"))
        summed, total = summed.join(more, "row", "left"), F.col("total") + F.coalesce("more", F.lit(0.0))
    return summed.select("doc_id", F.round(total / F.greatest("n_words", F.lit(1)), 9).alias("ratio"))


def curve(sample: list[tuple[float, int]], rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (ratio, label), held a little towards flat. The slope is never below 0."""
    import numpy as np

    if not sample:
        return 0.0, 0.0
    x, y = (np.array(c, float) for c in zip(*sorted(sample)))
    scale = x.std() or 1.0
    a, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        pull = np.array([1e-2, 1e-2])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (y - p) - pull * w)
        # Where the classes part cleanly, a full step may overshoot.
        w = w + step * min(1.0, 5 / (np.abs(step).max() or 1.0))
    return max(0.0, float(w[0] / scale)), float(w[1])


def score(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS) -> DataFrame:
    """docs(doc_id, text) as doc_id, held_out, score and predicted, learned from labels(doc_id, toxic).

    Only labels of documents outside of the held-out fold are read; of these one in CURVE_PART fits the curve, at most
    curve_rows, and the rest are counted, all of them. A doc_id with several labels is toxic if one says so; null
    labels and documents without a doc_id teach nothing, and the latter are not held out. A null text has no words, and texts without words
    get what the curve has for no evidence. Each row is scored by its text alone. Without labels every score is
    0.5. An empty table gives an empty result; other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    learned = fold(F.col("doc_id")) % FOLDS != HELD_OUT
    for_curve = F.floor(fold(F.col("doc_id")) / FOLDS) % CURVE_PART == 0
    known = written(known.filter(learned))
    # Only texts that may be counted move, and in the same way whatever the number of labels.
    counted = known.filter(~for_curve).hint("shuffle_hash")
    model = telling(docs.filter(learned & ~for_curve).join(counted, "doc_id"))
    ratios = written(log_ratios(docs, model))
    sample = ratios.join(known.filter(for_curve), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "ratio").limit(curve_rows).select("ratio", "toxic").collect()
    slope, offset = curve([tuple(r) for r in sample])
    probability = 1 / (1 + F.exp(-(F.lit(slope) * F.col("ratio") + F.lit(offset))))
    out = F.coalesce(fold(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    return ratios.select("doc_id", out.alias("held_out"), probability.alias("score"), (probability >= THRESHOLD).cast("int").alias("predicted"), "ratio")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: how toxic every document is, learned from the labels of two folds of three."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
