"""Masking a stream with a project's numbers in keyed state: a batch reads and writes the values it meets, however many there are.

Documents are masked where detectors find something. A document that comes again within the watermark is left
aside, and a value has its number from the state; only new ones are minted, in the order of time and doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from piiflow.functions.placeholders import format_placeholder
from piiflow.operators.detectors import pattern_spans
from piiflow.operators.spans import resolve, rewrite
from piiflow.operators.tokens import counter

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "project_id string, doc_id long, ts timestamp, text string, edits array<struct<start:bigint,end:bigint,value:string,kind:string,number:bigint,minted:boolean>>"


class Numbers(StatefulProcessor):
    """The numbers of a project's values, the last number of each counter, and, where counters may read alike, what is taken."""

    def __init__(self, shared: bool):
        self.shared = shared

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "value string", "number bigint, kind string")
        self.last = handle.getMapState("last", "counter string", "number bigint")
        self.taken = handle.getMapState("taken", "form string", "number bigint")

    def _number(self, value: str, kind: str, counter: str) -> tuple[int, str, bool]:
        if known := self.numbers.getValue((value,)):
            return known[0], known[1], False
        n = (self.last.getValue((counter,)) or (0,))[0] + 1
        # A with number 11 reads like A1 with number 1.
        while self.shared and self.taken.containsKey((f"{counter}{n}",)):
            n += 1
        self.numbers.updateValue((value,), (n, kind))
        self.last.updateValue((counter,), (n,))
        if self.shared:
            self.taken.updateValue((f"{counter}{n}",), (n,))
        return n, kind, True

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        # The order of a batch's documents decides their numbers, so a project's are sorted here.
        batch = pd.concat(list(rows)).sort_values(["ts", "doc_id"], kind="stable")
        for doc in batch.itertuples(index=False):
            edits = []
            for s in doc.spans:
                n, kind, minted = self._number(s["value"], s["kind"], s["counter"])
                edits.append({"start": s["start"], "end": s["end"], "value": s["value"], "kind": kind, "number": n, "minted": minted})
            yield pd.DataFrame({"project_id": [key[0]], "doc_id": [doc.doc_id], "ts": [doc.ts], "text": [doc.text], "edits": [edits]})

    def close(self) -> None:
        pass


class KeyedMasker:
    """docs(project_id, doc_id, ts, text) in; project_id, doc_id, text, n_replaced and the variables that the document added out.

    delay: how much later than others a document may come. Later ones are dropped, and one that comes again within it too. A
    null text and a null project come out as they are, without edits. A micro-batch's documents of one project are one task's work, as each may
    need a number after the one before.
    """

    def __init__(self, style: str = "kindNumber", detectors: tuple[str, ...] = ("email", "pin", "org", "postal", "phone"), delay: str = "1 hour"):
        self.style, self.detectors, self.delay = style, detectors, delay

    def masked(self, docs: DataFrame) -> DataFrame:
        docs = docs.select(F.col("project_id").cast("string"), F.col("doc_id").cast("long"), F.col("ts").cast("timestamp"), "text")
        once = docs.withWatermark("ts", self.delay).dropDuplicatesWithinWatermark(["project_id", "doc_id"])
        spans = F.when(F.col("project_id").isNotNull(), resolve(pattern_spans(F.col("text"), self.detectors)))
        asked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["kind"].alias("kind"), counter(self.style, s["kind"]).alias("counter")))
        none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,kind:string,counter:string>>")
        rows = once.withColumn("spans", F.coalesce(asked, none))
        numbered = rows.groupBy("project_id").transformWithStateInPandas(Numbers(self.style in ("kindNumber", "mustache")), _OUT, "append", "none")
        token = lambda e: format_placeholder(self.style, e["number"], e["kind"])
        edits = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), token(e).alias("replacement")))
        added = F.transform(F.filter("edits", lambda e: e["minted"]), lambda e: F.struct(e["value"].alias("value"), token(e).alias("token"), e["kind"].alias("kind")))
        return numbered.select("project_id", "doc_id", rewrite(F.col("text"), edits).alias("text"), F.size("edits").cast("long").alias("n_replaced"), added.alias("added"))

    def start(self, stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
        """The masked stream as a table under path. Keyed state is kept by RocksDB, for this query alone."""
        conf = stream.sparkSession.conf
        before = conf.get(_PROVIDER, None)
        conf.set(_PROVIDER, _ROCKS)
        try:
            writer = self.masked(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
        finally:
            conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
