"""Source divergence audit: how far the term distributions of sources lie apart, and which terms stand out.

The distance of two sources of a language is the sum of abs(p - q) over all of its kept terms, of which most sources
hold few. Inclusion and exclusion over the supports (the terms that a source holds) leave three parts:

- one-sided: a term that A holds costs abs(p_A(count) - p_B(0)) as if B lacked it. That depends on the count
  alone, so the histogram of A's counts prices all of A's terms at once, for each B; and the same the other way;
- both zero: every other term costs the constant abs(p_A(0) - p_B(0)); their number follows from the two supports and the overlap;
- overlap: terms that both hold were priced twice, and wrongly. Postings of a term (its sources) are joined with
  each other to put in the right price and take out the two one-sided ones and the constant.

No table of sources by terms is made. Numbers are whole and sums exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piiflow.llm.common import spread, written

MIN_DOCS = 30
TOP_TERMS = 50
#: The unit of probabilities, and what is added to every count.
UNIT, ADDED = 1_000_000_000, 5
#: A task hands on what it has counted when it holds so many terms.
HELD = 200_000

_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)).lower()
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often terms occur in each language and source, and in how many documents."""
    from collections import Counter

    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def table() -> pa.RecordBatch:
        flat = [(*group, term, k, docs[group][term]) for group, terms in n.items() for term, k in terms.items()]
        lang, source, term, counts, of_docs = zip(*flat)
        n.clear()
        docs.clear()
        arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(of_docs, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary())):
            if not text.is_valid:
                continue
            terms = Counter(text.as_py().translate(_LETTERS).split())
            if not terms:
                continue
            own = n.setdefault((lang, source), Counter())
            held -= len(own)
            own.update(terms)
            held += len(own)
            docs.setdefault((lang, source), Counter()).update(terms.keys())
            if held > HELD:
                yield table()
                held = 0
    if n:
        yield table()


def _p(count: Column, total: Column, kept: Column) -> Column:
    """The probability of a term in units, at least 1."""
    top = (count + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, (total + ADDED * kept).cast("decimal(20,0)"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """docs(lang, source, text) as (lang, source, term, n) of the terms that a language keeps, and (lang, source) of all groups."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(none("lang"), none("source"), none("text"))
    groups = docs.select("lang", "source").distinct()
    counts = docs.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")
    return written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n")), written(groups)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """docs(lang, source, text) as lang, source, part, item, value and rank.

    Terms are runs of ASCII letters and of all beyond ASCII, A-Z in lower case. A language keeps those in min_docs
    of its documents. p of a term in a group is 1 + floor(UNIT * (count + ADDED) / (N + ADDED * V)), N being the
    group's count of kept terms and V their number. Part "pair": every other source of the language with the sum of abs(p - q).
    Part "term": the top terms of a group by p - q, q being the language's, where that is positive and the group holds the term.
    Ranks go by value, then by the item's bytes.

    A null lang, source or text is an empty string. Each row is a document, repeated ones too. A group without terms
    has pairs and no terms; a language without kept terms has pairs of value 0. An empty table gives an empty result, and other
    columns are left out.
    """
    postings, groups = term_counts(docs, min_docs)
    by_term = postings.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    of_lang = written(by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_total")))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    sizes = groups.join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(1)
    # One row for each source, with its price of a term that it lacks.
    sizes = written(sizes.fillna(0, ["total", "held", "v", "lang_total"]).withColumn("zero", zero))
    priced = written(postings.join(sizes.drop("held"), ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v"))).select("lang", "source", "term", "n", "p", "zero", "v", "lang_total"))
    pairs = _pairs(priced, sizes)
    terms = priced.join(by_term, ["lang", "term"]).withColumn("value", F.col("p") - _p(F.col("all_n"), F.col("lang_total"), F.col("v")))
    terms = terms.filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def _pairs(priced: DataFrame, sizes: DataFrame) -> DataFrame:
    side = lambda k, *columns: sizes.select("lang", *[F.col(c).alias(f"{c}_{k}") for c in ("source", *columns)])
    # The histogram of each source's counts, priced against every source of its language.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).withColumnRenamed("source", "source_a")
    cost = F.sum(F.col("terms") * F.abs(F.col("p") - F.col("zero_b")))
    one_sided = written(histogram.join(side("b", "zero"), "lang").filter("source_a <> source_b").groupBy("lang", "source_a", "source_b").agg(cost.alias("cost")))
    # The postings of a term, joined with each other.
    a = priced.select("lang", "term", F.col("source").alias("source_a"), F.col("p").alias("p_a"), F.col("zero").alias("zero_a"))
    b = priced.select("lang", "term", F.col("source").alias("source_b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    correction = F.sum(gap("p_a", "p_b") - gap("p_a", "zero_b") - gap("zero_a", "p_b"))
    overlap = a.join(b, ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.count("*").alias("both"), correction.alias("correction"))
    pair = ["lang", "source_a", "source_b"]
    found = side("a", "held", "zero").join(side("b", "held", "zero"), "lang").filter("source_a < source_b").join(sizes.select("lang", "v").distinct(), "lang")
    there = one_sided.withColumnRenamed("cost", "there")
    back = one_sided.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("cost").alias("back"))
    found = found.join(overlap, pair, "left").join(there, pair, "left").join(back, pair, "left").fillna(0, ["both", "correction", "there", "back"])
    neither = F.col("v") - F.col("held_a") - F.col("held_b") + F.col("both")
    value = F.col("there") + F.col("back") + F.col("correction") + neither * gap("zero_a", "zero_b")
    ends = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    found = found.select("lang", value.alias("value"), ends.alias("end"))
    return found.select("lang", "end.source", F.lit("pair").alias("part"), "end.item", F.when(F.col("value").isNull(), 0).otherwise(F.col("value")).cast("long").alias("value"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: how far each source lies from the others of its language, and its terms that stand out."""
    return divergence(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), terms AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS all_n FROM terms GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS lang_total FROM kept GROUP BY lang
), held AS (
  SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM terms t JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM held GROUP BY ALL
), priced AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000 * (coalesce(h.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
    1 + (1000000000 * (k.all_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
