"""Secret scans: patterns find candidates, a random forest removes the false positives.

The forest reads a candidate's length, its character transitions (how surprising its letters are after
each other, and how often the kind of character changes), how much of it dictionary words cover, the path
of its document and the words beside it, and is trained from labelled findings. Dictionary and transitions
are learned from all words of the documents that are scanned: a word is in the dictionary if a share of the
documents holds it. Candidates, features and scores are SQL functions, joins and Spark's own forest; nothing
runs outside the JVM. Only documents with a candidate are cut up; what is shuffled are candidates, and
words by how many documents hold them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.llm.common import held, spread, written

#: What a candidate looks like. The key of an assignment is part of the match; the rest is the value.
#: Nothing is bounded above, and possessive parts keep long runs from being read again and again.
ASSIGNED = r"(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
ASSIGNMENT = r"(?>[\w-]*" + ASSIGNED + r")[\w-]*+[\x22']?+[\x20\x09]*+(?>=>|:=|[=:])[\x20\x09]*+[\x22']?+"
#: A private key's block, whole or, where its end is missing, as far as its lines go.
PEM = (
    r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{40,}+)++)"
)
CANDIDATE = (
    r"(?i:(?<![\w-])" + ASSIGNMENT + r")(?:" + PEM + r"|[^\s\x22'<>]{6,})|" + PEM
    + r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|xox[abp]-|sk-|sk_live_)[A-Za-z0-9_-]{16,}"
    r"|(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])|(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"
)
KEY = r"(?i)^" + ASSIGNMENT
#: Words beside a candidate or in its key, and parts of a path, that say something about it.
NEAR_SECRET = r"(?i)pass|pwd|secret|token|key|auth|credential|login|bearer"
NEAR_OTHER = r"(?i)commit|sha\d*|md5|hash|digest|checksum|etag|revision|uuid|example|sample|dummy|placeholder|integrity|blob|tree"
OTHER_PATH = r"(?i)test|example|sample|mock|fixture|doc|readme|demo"
MIN_DOCS, MIN_SHARE = 3, 1e-5
TREES, DEPTH, SEED = 32, 9, 17
FEATURES = ("n_chars", "changes", "surprise", "digits", "upper", "symbols", "hexes", "distinct", "covered", "longest_word", "assigned", "by_secret", "by_other", "path_other", "prefixed")


@dataclass
class Language:
    """What words look like: a table of words with n_docs, and -log2 of the chance of each letter (a-z) after each."""

    words: DataFrame
    surprise: list[float]


def learn(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> Language:
    """The language of docs(text): words of three letters or more that min_docs documents and min_share of all hold.

    A pair of letters counts once for each document that holds its word. What reaches the driver are the
    counts of 676 pairs. Without documents there are no words, and all pairs are equally likely.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    found = docs.select(F.explode(F.array_distinct(F.split(text, r"[^\p{L}]+"))).alias("word")).filter(F.length("word") >= 3)
    counted = found.groupBy("word").agg(F.count("*").alias("n_docs"))
    least = max(min_docs, math.ceil(min_share * docs.count()))
    words = written(counted.filter(F.col("n_docs") >= least))
    letters = F.split("word", "")
    pairs = F.transform(F.sequence(F.lit(0), F.size(letters) - 2), lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1)))
    seen = words.select("n_docs", F.explode(pairs).alias("pair")).filter(F.rlike("pair", F.lit("^[a-z]{2}$"))).groupBy("pair").agg(F.sum("n_docs").alias("n")).collect()
    counts = {r.pair: r.n for r in seen}
    rows = [[counts.get(chr(97 + a) + chr(97 + b), 0) for b in range(26)] for a in range(26)]
    # One occurrence more for all, so that none is impossible.
    return Language(words, [-math.log2((n + 1) / (sum(row) + 26)) for row in rows for n in row])


def _by_value(findings: DataFrame, language: Language) -> DataFrame:
    """Each distinct value with covered and longest_word: its letters that dictionary words cover."""
    values = findings.select("value").distinct()
    # A run of letters, cut where a capital follows a small letter.
    runs = F.filter(F.split("value", r"[^\p{L}]+|(?<=\p{Ll})(?=\p{Lu})"), lambda w: F.length(w) >= 3)
    parts = values.select("value", F.explode(F.transform(runs, lambda w: F.lower(w))).alias("word"))
    known = parts.join(language.words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("_letters"), F.max(F.length("word")).alias("_longest"))
    return known.withColumnRenamed("value", "_of")


def features(findings: DataFrame, language: Language) -> DataFrame:
    """findings(key, value, before, after, path) with FEATURES as doubles. Nulls count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = _by_value(findings, language)
    findings = findings.join(known, findings["value"] == known["_of"], "left").drop("_of")
    value = text("value")
    n = F.greatest(F.length(value), F.lit(1))
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^a-zA-Z0-9])(?=[a-zA-Z0-9])"
    findings = held(findings, _codes=F.transform(F.split(F.lower(value), ""), lambda c: F.ascii(c) - 97))
    table = F.array(*map(F.lit, language.surprise))
    letter = lambda c: c.between(0, 25)
    after = lambda i: F.get("_codes", i + 1)
    pairs = F.transform("_codes", lambda c, i: F.when(letter(c) & letter(after(i)), c * 26 + after(i)))
    findings = held(findings, _pairs=F.filter(pairs, lambda p: p.isNotNull()))
    surprise = F.aggregate("_pairs", F.lit(0.0), lambda total, p: total + F.get(table, p)) / F.greatest(F.size("_pairs"), F.lit(1))
    around = F.concat_ws(" ", text("before"), text("key"), text("after"))
    flag = lambda c: c.cast("double")
    return findings.withColumns(
        {
            "n_chars": F.length(value).cast("double"),
            "changes": share(changes),
            "surprise": surprise,
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "symbols": share(r"[^\p{L}\p{N}]"),
            "hexes": share("[0-9a-f]"),
            "distinct": F.size(F.array_distinct("_codes")) / F.least(n, F.lit(40)),
            "covered": F.coalesce("_letters", F.lit(0)) / n,
            "longest_word": F.coalesce("_longest", F.lit(0)).cast("double"),
            "assigned": flag(text("key") != ""),
            "by_secret": flag(F.rlike(around, F.lit(NEAR_SECRET))),
            "by_other": flag(F.rlike(F.concat_ws(" ", text("before"), text("after")), F.lit(NEAR_OTHER))),
            "path_other": flag(F.rlike(text("path"), F.lit(OTHER_PATH))),
            "prefixed": flag(F.rlike(value, F.lit(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abp]-|sk-|sk_live_|eyJ|-----BEGIN )"))),
        }
    ).drop("_codes", "_pairs", "_letters", "_longest")


def train(findings: DataFrame, language: Language, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most: int = 20_000) -> PipelineModel:
    """A forest from findings(key, value, before, after, path, secret), secret being 1 or 0.

    most: the forest is fitted on at most so many labelled rows, those first by a hash of their content.
    """
    rows = findings.withColumn("_order", F.xxhash64("key", "value", "before", "after", "path")).orderBy("_order", "secret").limit(most).drop("_order")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted")
    # One partition in one order: the split of rows, and so the forest, doesn't depend on the cluster.
    sample = written(features(rows, language).select(*FEATURES, F.col("secret").cast("double").alias("_label")).coalesce(1).sortWithinPartitions(*FEATURES, "_label"))
    model: RandomForestClassificationModel = forest.fit(ready.transform(sample.coalesce(1)))
    return PipelineModel([ready, model])


#: Words that people write where a secret belongs.
STAND_INS = "changeme password secret example letmein qwerty welcome admin dummy default token required hidden redacted placeholder undefined".split()


#: Where files with settings lie, and where examples do. Of secrets EXAMPLE_SHARES[1] percent are found in the latter, of others EXAMPLE_SHARES[0]
#: percent; as many of each are followed by a word that says so.
SETTING_PATHS = ("src0", "src1", "src2", "web", "crawl", "app/config.py", "deploy.sh", "settings.yml", ".env", "ci/release.yml")
EXAMPLE_PATHS = ("docs/setup", "tests/a.py", "README.md", "tests/fixtures/example.py", "demo/app.py", "mock/server.js", "samples/conf.yml")
EXAMPLE_WORDS = ("example", "sample", "dummy", "placeholder")
EXAMPLE_SHARES = (45, 8)


def labelled_findings(spark: SparkSession, language: Language, n: int = 8000, most_words: int = 2000) -> DataFrame:
    """Findings with known answers, n rows that are the same on each run over the same documents.

    There are no labelled secrets in the tables, so their values are drawn: secrets from digests, as keys are,
    in the alphabets and lengths of keys and passwords; the others from words of the documents (at most
    most_words of them, those first by a hash, however rare in the dictionary), joined as people join them, from code
    that names a secret without holding it, and from digests that are no secrets by what stands beside them. Others lie
    more often than secrets in paths of examples and beside words that say so, by EXAMPLE_SHARES: an assumption, as there is no
    repository to count in.
    """
    kept = language.words.filter(F.length("word").between(4, 12)).orderBy(F.xxhash64("word"), "word").limit(most_words).select("word")
    kept = written(kept.unionByName(spark.createDataFrame([(w,) for w in STAND_INS], "word string")))
    # Each row has a word and the four that follow it in an order of hashes; a short list comes round again.
    rounds = kept.select("word", F.explode(F.sequence(F.lit(0), F.lit(n // kept.count()))).alias("_round"))
    order = Window.orderBy(F.xxhash64("word", "_round"), "word")
    numbered = rounds.select((F.row_number().over(order) - 1).cast("long").alias("id"), F.array("word", *[F.coalesce(F.lead("word", k).over(order), "word") for k in range(1, 5)]).alias("_words"))
    numbered = written(numbered.filter(F.col("id") < n))
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    drawn = lambda salt, upto: f"CAST(pmod(xxhash64({quoted(salt)}, id), {upto}) AS INT)"
    number = lambda salt, upto: F.expr(drawn(salt, upto))
    pick = lambda salt, options: F.expr(f"get(array({', '.join(map(quoted, options))}), {drawn(salt, len(options))})")
    long = lambda salt: F.concat(*[F.sha2(F.concat(F.lit(f"{salt}{k}:"), F.col("id").cast("string")), 256) for k in range(4)])
    cut = lambda text, salt, least, most: F.substr(text, F.lit(1), F.lit(least) + number(salt, most - least + 1))
    base64 = lambda salt: F.base64(F.unhex(long(salt)))
    plain = lambda salt: F.translate(base64(salt), "+/=", "xYz")
    word = lambda salt: F.when(number(salt + "?", 6) == 0, pick(salt, STAND_INS)).otherwise(F.get("_words", number(salt, 5)))
    prose = lambda salt: F.when(number(salt + "e", 8) == 0, "").otherwise(word(salt))
    keys = ("password=", 'token = "', "secret: ", "api_key=", "auth_token=", "pwd=", "access_key = '", '"client_secret": "', "DB_PASSWORD=", "token => '")
    key = lambda salt: pick(salt, keys)
    of_example = lambda salt, secret: number(salt, 100) < EXAMPLE_SHARES[secret]
    path = lambda salt, secret: F.when(of_example(salt + "%", secret), pick(salt, EXAMPLE_PATHS)).otherwise(pick(salt, SETTING_PATHS))
    behind = lambda salt, secret: F.when(of_example(salt + "%", secret), pick(salt, EXAMPLE_WORDS)).otherwise(prose(salt))
    digits = lambda salt, upto: number(salt, upto).cast("string")
    no = F.lit("")
    named = ("commit", "sha1", "revision", "blob", "tree", "sha256:", "digest", "checksum", "integrity", "md5", "etag")
    secrets = [
        (key("a"), cut(long("a"), "al", 16, 64)), (key("b"), cut(base64("b"), "bl", 16, 88)), (key("c"), cut(plain("c"), "cl", 12, 40)),
        (key("d"), cut(F.translate(base64("d"), "+/=ABCDabcd01", "!@#$%^&*-_!?."), "dl", 8, 20)),
        (key("e"), F.upper(cut(long("e"), "el", 20, 64))), (key("f"), cut(F.translate(long("f"), "abcdef", "ghkmpx"), "fl", 12, 40)),
        (no, F.concat(pick("g", ("AKIA", "ASIA")), F.translate(F.upper(F.substr(plain("g"), F.lit(1), F.lit(16))), "01", "AB"))),
        (no, F.concat(pick("h", ("ghp_", "gho_", "sk-", "sk_live_", "xoxb-")), cut(plain("h"), "hl", 20, 60))),
        (no, F.concat(F.lit("eyJ"), cut(plain("i"), "il", 12, 60), F.lit("."), cut(plain("i2"), "il2", 20, 160), F.lit("."), cut(plain("i3"), "il3", 20, 86))),
        (pick("j0", ("", "secret: ")), F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), base64("j"), F.lit("\n"), base64("j2"), F.lit("\n-----END PRIVATE KEY-----"))),
    ]
    others = [
        (key("m"), F.concat(word("m1"), word("m2"), digits("m3", 1000)), prose("mb")), (key("n"), F.concat(word("n1"), digits("n2", 100)), prose("nb")),
        (key("o"), F.concat(pick("o1", ("<your-", "${", "{{", "%(", "$(get-", "[")), word("o2"), pick("o3", ("-here>", "}", "}}", ")s", ")", "]"))), prose("ob")),
        (key("p"), F.repeat(pick("p1", ("x", "0", "*", "a", "1", "-", ".")), F.lit(6) + number("p2", 30)), prose("pb")),
        (key("q"), F.concat(word("q1"), pick("q2", ("_", ".", "-", "::")), word("q3"), pick("q4", ("", "()", "[0]", ".get(", ";"))), prose("qb")),
        (key("r"), F.concat(word("r1"), F.initcap(word("r2")), F.initcap(word("r3")), pick("r4", ("", "()", ",", ")"))), prose("rb")),
        (key("s"), F.concat(pick("s1", ("/", "https://", "./")), word("s2"), pick("s3", ("/", ".com/")), word("s4"), pick("s5", (".py", ".txt", "", ".json"))), prose("sb")),
        (key("t"), F.substr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz0123456789"), F.lit(1) + number("t1", 12), F.lit(6) + number("t2", 26)), prose("tb")),
        (key("u"), F.concat(word("u1"), word("u2")), prose("ub")),
        (no, cut(long("v"), "vl", 32, 64), pick("vb", named)), (no, F.substr(long("w"), F.lit(1), pick("wl", (40, 64))), pick("wb", named)),
        (no, F.concat(F.lit("AKIA"), F.rpad(F.upper(F.concat(word("x1"), F.lit("EXAMPLE"))), 16, "X")), prose("xb")),
    ]
    # Made-up keys of fixtures and manuals look like secrets, and are told by their place or by the word after them.
    fakes = [(key("y"), cut(long("y"), "yl", 16, 64), True, False), (key("z"), cut(plain("z"), "zl", 8, 40), True, False), (key("ä"), cut(long("ä"), "äl", 8, 64), False, True), (key("ö"), cut(plain("ö"), "öl", 8, 40), False, True)]
    rows = [(k, v, prose(f"sb{i}"), 1, False, False) for i, (k, v) in enumerate(secrets)] + [(k, v, b, 0, False, False) for k, v, b in others]
    rows += [(k, v, prose(f"fb{i}"), 0, *where) for i, (k, v, *where) in enumerate(fakes)]
    # Each kind is a small select of its own: one expression for all would be too long to compile.
    parts = [
        numbered.filter(F.col("id") % len(rows) == i).select(
            k.alias("key"), v.alias("value"), b.alias("before"), (pick(f"w{i}", EXAMPLE_WORDS) if told else behind(f"a{i}", y)).alias("after"),
            (pick(f"f{i}", EXAMPLE_PATHS) if fixture else path(f"p{i}", y)).alias("path"), F.lit(y).alias("secret"),
        )
        for i, (k, v, b, y, fixture, told) in enumerate(rows)
    ]
    return written(reduce(DataFrame.unionAll, parts).filter("value IS NOT NULL"))


def _may_hold(text: Column) -> Column:
    """A cheap look first: what every candidate has, as plain parts of a text or a run of hex."""
    low = F.lower(text)
    parts = [F.contains(low, F.lit(x)) for x in ("pass", "pwd", "secret", "token", "key", "auth")]
    parts += [F.contains(text, F.lit(x)) for x in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "sk-", "sk_live_", "eyJ")]
    return reduce(Column.__or__, parts) | F.rlike(text, F.lit("[0-9A-Fa-f]{32}"))


def candidates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) as doc_id, path, start (from 0, in code points), key, value, before and after."""
    docs = docs.filter(_may_hold(F.col("text"))).filter(F.rlike("text", F.lit(CANDIDATE)))
    df = held(docs.select("doc_id", F.col("source").alias("path"), "text"), found=F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), gaps=F.split("text", CANDIDATE, -1))
    spot = F.transform(
        "found",
        lambda m, i: F.struct(
            i.alias("i"),
            m.alias("match"),
            F.length(F.get("gaps", i)).alias("gap"),
            # The whole word on each side, however long and however far: a word is tried at its beginning only.
            F.regexp_extract(F.get("gaps", i), r"(?<!\S)(\S++)\s*+\z", 1).alias("before"),
            F.regexp_extract(F.get("gaps", i + 1), r"\A[\x22']?+\s*+(\S++)", 1).alias("after"),
        ),
    )
    # Starts add up within a row, whatever its identifier; its content and candidates name it.
    df = df.select("doc_id", "path", F.xxhash64("doc_id", "path", "text").alias("_row"), F.inline(spot)).distinct()
    upto = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(upto)
    key = F.regexp_extract("match", KEY, 0)
    return df.select("doc_id", "path", (end - F.length("match") + F.length(key)).cast("long").alias("start"), key.alias("key"), F.substr("match", F.length(key) + 1).alias("value"), "before", "after")


def scan(docs: DataFrame, model: PipelineModel, language: Language) -> DataFrame:
    """All candidates of docs(doc_id, source, text) with probability and secret, the forest's verdict.

    A null text has no candidates, a null source is an empty path, and a null doc_id stays null. Rows that
    repeat doc_id, source and text give their findings once; other columns of docs are left out. An empty
    table gives an empty result.
    """
    # Written once: their values are looked up in the dictionary, and come back to them.
    scored = model.transform(features(written(candidates(docs)), language))
    probability = F.round(F.get(vector_to_array("_probability"), 1), 9)
    return scored.withColumns({"probability": probability, "secret": probability >= 0.5}).drop("_features", "_raw", "_probability", "_predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every candidate's place, digest and verdict; no secret itself."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    language = learn(docs)
    found = scan(docs, train(labelled_findings(spark, language), language), language)
    return found.select("doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "secret")
