"""A corpus masked in one go: detect everywhere, mint once, rewrite everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.operators.candidates import detect, group
from piiflow.operators.tokens import mask, plan
from piiflow.sources.stores import materialize


def decide(spans: DataFrame, on: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Every value found, included, in the order of its first place in the project."""
    first = F.min(F.struct(*key, "start"))
    values = spans.groupBy(*on, "value").agg(first.alias("_at"), F.min_by("kind", F.struct(*key, "start")).alias("kind"))
    # Ranks would need one order of a whole project; a number that sorts like the place does not.
    return values.select(*on, "value", "kind", F.lit(True).alias("include"), F.col("_at").alias("decision_order"))


def mask_corpus(docs: DataFrame, variables: DataFrame, spans: Column, style: str = "kindNumber", more: Sequence[DataFrame] = (), on: Sequence[str] = ("project_id",), key: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Masked documents and the variables they need.

    All documents are searched with the variables there are, then new values get tokens in document order,
    and then all documents are rewritten with all of them. Document after document would differ where a
    value minted early lies across one found later.
    """
    found = detect(docs, spans, more, None if variables.isEmpty() else variables, on=on, key=key)
    # Written once: minting and rewriting read what was found more than once.
    decisions = materialize(decide(found, on, key))
    after = materialize(plan(decisions, variables, style, on))
    return mask(docs, after, on, key), after
