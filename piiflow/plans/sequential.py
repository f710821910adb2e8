"""A project masked document after document, as a person does it: what one document adds is known to the next ones only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.operators.candidates import VARIABLE_PRIORITY
from piiflow.operators.literals import Finder, longest_first as longest_literals
from piiflow.operators.spans import longest_first, rewrite
from piiflow.operators.tokens import SUFFIXES, plan
from piiflow.sources.stores import materialize

_ROWS = "project string, at long, added array<struct<value:string,kind:string>>, edits array<struct<start:bigint,end:bigint,value:string>>"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order; those of a project lie together, after a row with the variables that it has already."""
    added_type = pa.list_(pa.struct([("value", pa.string()), ("kind", pa.string())]))
    edits_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    project, finder, values, known = None, Finder((), SUFFIXES), [], {}
    for batch in batches:
        out = []
        for key, text, known_before, spans in zip(*(batch[c].to_pylist() for c in ("project", "text", "variables", "spans"))):
            if key != project:
                project, finder, values, known = key, Finder((), SUFFIXES), [], {}
            fresh = [(v["value"], v["kind"]) for v in known_before or ()]
            if text is not None:
                found = [(s["start"], s["end"], s["priority"], s["seq"], s["value"], s["kind"]) for s in spans or ()]
                found += [(at, at + len(values[k]), VARIABLE_PRIORITY, 0, values[k], known[values[k]]) for at, k in finder.places(text)]
                fresh = [found[k][4:] for k in longest_first(found)]
            # The first place of a value decides its kind.
            firsts: dict[str, str] = {}
            for value, kind in fresh:
                if value and value not in known:
                    firsts.setdefault(value, kind)
            for value, kind in firsts.items():
                finder.add(value, len(values))
                values.append(value)
                known[value] = kind
            places = longest_literals(finder.places(text), values) if text is not None else ()
            out.append(([{"value": v, "kind": k} for v, k in firsts.items()], [{"start": at, "end": at + len(values[k]), "value": values[k]} for at, k in places]))
        added, edits = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch["project"], batch["at"], pa.array(added, added_type), pa.array(edits, edits_type)], ["project", "at", "added", "edits"])


def mask_in_order(docs: DataFrame, variables: DataFrame, spans: Column, order: str = "doc_order", style: str = "kindNumber") -> tuple[DataFrame, DataFrame]:
    """docs(project_id, text, ...) masked one after another in each project, with n_replaced, and the variables after all.

    Each document is searched with the variables there are by then, every value found gets a variable, and all of
    these are applied to it. So a value minted early may lie across a longer one found later, which mask_corpus would take whole, and
    a document is not masked with what only later ones add. order is unique within a project. A null text stays, and adds nothing;
    a null project has none of the variables and masks nothing.

    A project is one task's work, as each document depends on those before it; what the task holds are the project's distinct values. Minting and
    rewriting go on in all tasks.
    """
    docs = docs.drop("n_replaced")
    rows = docs.select(F.col("project_id").cast("string").alias("project"), F.col(order).cast("long").alias("at"), "text", spans.alias("spans")).filter("project IS NOT NULL")
    before = variables.groupBy(F.col("project_id").cast("string").alias("project")).agg(F.sort_array(F.collect_list(F.struct("variable_order", "value", "kind"))).alias("v"))
    before = before.select("project", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("text"), F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"))).alias("variables"))
    both = before.unionByName(rows, allowMissingColumns=True)
    folded = both.repartition("project").sortWithinPartitions("project", F.col("at").asc_nulls_first()).select("project", "at", "text", "variables", "spans").mapInArrow(_folded, _ROWS)
    folded = materialize(folded.filter("at IS NOT NULL"))
    new = folded.select("project", "at", F.posexplode("added").alias("i", "new")).select(
        F.col("project").alias("project_id"), "new.value", "new.kind", F.lit(True).alias("include"), F.struct("at", "i").alias("decision_order")
    )
    after = materialize(plan(new, variables, style))
    tokens = after.select(F.col("project_id").cast("string").alias("project"), "value", "token")
    edits = folded.select("project", "at", F.inline("edits")).join(tokens, ["project", "value"])
    edits = edits.groupBy("project", "at").agg(F.collect_list(F.struct("start", "end", F.col("token").alias("replacement"))).alias("_edits"))
    joined = docs.join(edits, (docs["project_id"].cast("string") == edits["project"]) & (docs[order].cast("long") == edits["at"]), "left")
    text = F.when(F.col("_edits").isNotNull(), rewrite(docs["text"], F.col("_edits"))).otherwise(docs["text"])
    own = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*own, F.greatest(F.size("_edits"), F.lit(0)).cast("long").alias("n_replaced")), after
