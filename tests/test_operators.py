"""Behaviour of the library on small tables of our own."""

import random

import pytest
from pyspark.sql import functions as F

from piiflow.functions import checks, placeholders
from piiflow.functions import text as T
from piiflow.operators import candidates as C
from piiflow.operators import catalog, detectors as D, kinds, literals as L, search, spans as S, tokens
from piiflow.schema import SPANS


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("start").collect()]


@pytest.mark.parametrize(
    "detector, text, expected",
    [
        ("pin", "Hon är 811218-9876, född 19811218-9876 och 8112189876", ["811218-9876", "19811218-9876", "8112189876"]),
        ("pin", "811218-9877 811318-9876 811232-9876 98112189876123", []),
        ("pin", "811278-9873 och 811218+9876", ["811278-9873", "811218+9876"]),
        ("org", "556036-0793, 165560360793, 5560360793", ["556036-0793", "165560360793", "5560360793"]),
        ("org", "811218-9876 och 556036-0794", []),
        ("phone", "070-123 45 67, +46 70 123 45 67, 0046701234567, +46 (0)70 123 45 67, 08-123 456", ["070-123 45 67", "+46 70 123 45 67", "0046701234567", "+46 (0)70 123 45 67", "08-123 456"]),
        ("phone", "01-02-1999 och 0123 och 2024-01-02", []),
        ("email", "skriv till anna.berg@mail.example.se.", ["anna.berg@mail.example.se"]),
        ("postal", "Till 123 45 Uppsala, SE-123 45 och postnummer: 54321", ["123 45", "SE-123 45", "54321"]),
        ("postal", "Summa 123 45 kronor, order 12345.", []),
        ("street", "Storgatan 12, Karl Johans gata, Norra Långgatan 3 B lgh 1102", ["Storgatan 12", "Karl Johans gata", "Norra Långgatan 3 B lgh 1102"]),
        ("street", "I Stadsparken, på Järnvägen 3 och Omvägen", []),
    ],
)
def test_detectors(spark, detector, text, expected):
    found = one(spark, text).select(F.inline(S.resolve(D.pattern_spans(F.col("text"), (detector,)))))
    assert values(found) == expected


def test_names(spark):
    rows = [(1, "Vi såg Anna Svensson idag. Berg är högt, men Berg bor där. Annas bil. Domaren Nyberg och Sten Karin Fredriksson."), (2, "Per gick hem. Ett Hus."), (3, None), (4, "")]
    found = D.name_spans(spark.createDataFrame(rows, "doc_id long, text string"), D.seed_dictionary(spark))
    assert values(found.filter("doc_id = 1")) == ["Anna Svensson", "Berg", "Anna", "Nyberg", "Sten Karin Fredriksson"]
    assert found.filter("doc_id > 1").count() == 0


def test_check_digits_and_normal_forms(spark):
    df = spark.createDataFrame([("0",), ("00",), ("79927398713",), ("79927398710",), ("٣٣",), (None,)], "d string")
    assert [r[0] for r in df.select(checks.luhn_valid(F.col("d"))).collect()] == [False, True, True, False, False, False]
    df = spark.createDataFrame([("+46 (0)70-123 45 67",), ("0046 8 123456",), ("01-02-2003",), ("12",)], "d string")
    assert [r[0] for r in df.select(checks.normalize_phone(F.col("d"))).collect()] == ["0701234567", "08123456", None, None]


def test_overlaps_are_resolved_longest_first(spark):
    literals = spark.createDataFrame([("A B", "x", 0), ("B C D", "x", 1)], "value string, kind string, seq int")
    docs = one(spark, "A B C D")
    assert L.replace_literals(docs, literals.withColumn("replacement", F.lower("value"))).first().text == "A b c d"


@pytest.mark.parametrize("sent", [True, False])
def test_literals_know_bounds_suffixes_and_themselves(spark, monkeypatch, sent):
    monkeypatch.setattr(L, "SENT_ROWS", 100_000 if sent else 0)
    docs = one(spark, "Annas Anna Annan _Anna [N 1]s $1 $12 aaa")
    literals = spark.createDataFrame([("Anna",), ("[N 1]",), ("$1",), ("aa",), ("",)], "value string")
    starts = lambda **k: sorted((r.value, r.start) for r in L.find_literals(docs, literals, **k).collect())
    assert starts() == [("$1", 30), ("Anna", 6), ("[N 1]", 23)]
    assert starts(suffixes=["s"]) == [("$1", 30), ("Anna", 0), ("Anna", 6), ("[N 1]", 23)]
    assert [s for s in starts(whole_word=False) if s[0] == "aa"] == [("aa", 37), ("aa", 38)]


def test_pieces_put_together_are_the_text(spark):
    text = "ab 12 cd😀34"
    pieces = one(spark, text).select(F.inline(S.highlight(F.col("text"), S.find_spans(F.col("text"), "[0-9]+", "n", "n")))).collect()
    assert "".join(p.piece for p in pieces) == text
    assert [p.piece for p in pieces if p.kind] == ["12", "34"]


def test_pieces_of_crossing_nested_and_no_spans(spark):
    """A span that begins before the last kept one's end is no piece of its own."""
    span = lambda a, b, kind: (a, b, "", kind, "s", 0, 0)
    rows = [("abcdef", [span(0, 3, "x"), span(2, 4, "y"), span(4, 5, "z")]), ("abc", []), ("", []), ("ab", [span(0, 2, "x"), span(1, 2, "y")]), ("a" * 9000, [span(3 * k, 3 * k + 1, "k") for k in range(3000)])]
    got = spark.createDataFrame(rows, f"text string, s {S.SPANS}").select(S.highlight(F.col("text"), F.col("s")).alias("p")).collect()
    said = [[(p.piece, p.kind) for p in r.p] for r in got]
    assert said[0] == [("abc", "x"), ("d", None), ("e", "z"), ("f", None)]
    assert said[1:4] == [[("abc", None)], [], [("ab", "x")]]
    assert said[4] == [("a", "k"), ("aa", None)] * 3000


def test_patterns_of_users(spark):
    assert T.compile_pattern(spark, "(open") is None
    assert T.matches_empty(spark, "x*") and not T.matches_empty(spark, "x+")
    df = one(spark, "a b")
    assert df.select(F.rlike("text", F.lit(T.java_pattern(r"a\sb")))).first()[0]


def test_letters_and_styles(spark):
    df = spark.createDataFrame([(0,), (1,), (26,), (27,), (17576,), (17577,)], "i long")
    assert [r[0] for r in df.select(placeholders.letters(F.col("i"))).collect()] == ["AAA", "AAA", "AAZ", "ABA", "ZZZ", "BAAA"]
    row = df.limit(1).select(*[placeholders.format_placeholder(s, F.lit(3), F.lit("case no")).alias(s) for s in placeholders.STYLES]).first()
    assert tuple(row) == ("AAC", "aac", "$3", "CASENO3", "[CASENO 3]", "{{caseno3}}")


def test_minting_fills_gaps_and_steers_clear_of_other_kinds(spark):
    new = spark.createDataFrame([("p", "v1", "A", 1), ("p", "v2", "A", 2), ("p", "v3", "A1", 3)], "project_id string, value string, kind string, mint_order long")
    taken = spark.createDataFrame([("p", "A1"), ("p", "A3"), *[("p", f"A{k}") for k in range(4, 11)]], "project_id string, token string")
    got = {r.value: r.token for r in tokens.mint(new, taken, "kindNumber").collect()}
    assert got["v1"] == "A2" and got["v2"] == "A11" and got["v3"] == "A12"


def test_masking_comes_back(spark):
    docs = spark.createDataFrame([("p", 1, "Annas bror Erik och Anna Berg."), ("p", 2, "Erik")], "project_id string, doc_id long, text string")
    decisions = spark.createDataFrame([("p", v, "name", i, k) for k, (v, i) in enumerate([("Anna", True), ("Erik", True), ("Anna Berg", True), ("bror", False)])], "project_id string, value string, kind string, include boolean, decision_order long")
    plan = tokens.plan(decisions, spark.createDataFrame([], "project_id string, value string, token string, kind string, variable_order long"), "kindNumber")
    masked = tokens.mask(docs, plan)
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "NAME1s bror NAME2 och NAME3.", 2: "NAME2"}
    back = tokens.unmask(masked.drop("n_replaced"), plan)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_kind_labels(spark):
    stored = spark.createDataFrame([("a", '[{"id":"1","label":" Case  no "},{"id":"2","label":"CASE NO"},{"label":"x"},{"id":"3","label":""}]'), ("b", "{broken"), ("c", None)], "owner string, json string")
    assert [(r.owner, r.label, r.created_at) for r in kinds.parse_kinds(stored).collect()] == [("a", "Case no", "1970-01-01T00:00:00.000Z")]


def test_stored_workspaces_come_back(spark):
    rows = spark.createDataFrame([("w", '{"version":1,"projects":[{"id":"p","name":"n","ignored":["x"]}]}'), ("n", '{"version":9,"projects":[]}'), ("x", "{"), ("e", "")], "workspace string, body string")
    parsed = catalog.parse_stored(rows)
    assert {r.workspace: r.status for r in parsed.collect()} == {"w": "ok", "n": "newer", "x": "unreadable", "e": "blank"}
    again = catalog.parse_stored(catalog.serialize(parsed.filter("status = 'ok'"))).first()
    assert again.projects[0].ignored == ["x"] and again.active_id == "p"


def test_an_invalid_search_finds_nothing(spark):
    p = spark.createDataFrame([("p", "Alpha")], "project_id string, name string")
    d = spark.createDataFrame([("p", 1, "n", "beta ALPHA alpha")], "project_id string, doc_id long, name string, text string")
    v = spark.createDataFrame([("p", 1, "NAME1", "Alpha Ek")], "project_id string, variable_order long, token string, value string")
    assert search.search(p, d, v, "/(/").count() == 0 and search.search(p, d, v, "  ").count() == 0
    assert sorted((r.hit, r.n_matches) for r in search.search(p, d, v, "alpha").collect()) == [("document", 2), ("project", 1), ("variable", 1)]


def test_never_and_ignored_lists(spark):
    docs = one(spark, "a@x.se B@x.se c@x.se")
    never = spark.createDataFrame([("b@X.se",)], "value string")
    ignored = spark.createDataFrame([("c@x.se",)], "value string")
    found = C.detect(docs, D.pattern_spans(F.col("text"), ("email",)), never=never, ignored=ignored)
    assert values(found) == ["a@x.se"]


def test_sums_of_long_arrays(spark):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(9) for _ in range(n)]) for k, n in enumerate((0, 1, 127, 128, 129, 5000))]
    got = spark.createDataFrame(rows, "k int, a array<long>").select("k", S.running(F.col("a")).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: [sum(a[:i]) for i in range(len(a))] for k, a in rows}


def test_very_many_matches_in_one_text(spark):
    df = spark.createDataFrame([("é ab, " * 20_000,)], "text string")
    found = df.select(S.find_spans(F.col("text"), "ab", "x", "x").alias("s")).first().s
    assert [x.start for x in found] == [6 * k + 2 for k in range(20_000)]


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[5], s[0], s[6])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_clusters_resolve_as_whole_documents_do(spark):
    rng = random.Random(8)
    rows = []
    for doc in range(60):
        for seq in range(rng.randrange(0, 25)):
            start = rng.randrange(60)
            rows.append((doc, start, start + rng.randrange(1, 12), f"v{seq}", "k", "s", rng.randrange(3), seq))
    df = spark.createDataFrame(rows, "doc_id long, start long, end long, value string, kind string, source string, priority int, seq int")
    got = sorted((r.doc_id, r.start, r.end, r.value) for r in S.resolved(df, ["doc_id"]).collect())
    want = sorted((d, s[0], s[1], s[2]) for d in range(60) for s in greedy([r[1:] for r in rows if r[0] == d]))
    assert got == want


def test_edits_that_cross(spark):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(0, 30)))
        edits = []
        for _ in range(rng.randrange(0, 5)):
            a = rng.randrange(len(text) + 1)
            edits.append((a, rng.randrange(a, len(text) + 1), rng.choice(["", "X", "YY"])))
        rows.append((k, text, edits))
    df = spark.createDataFrame(rows, "k int, text string, e array<struct<start:long,end:long,replacement:string>>")
    got = {r.k: r.t for r in df.select("k", S.rewrite(F.col("text"), F.col("e")).alias("t")).collect()}
    for k, text, edits in rows:
        out, at = "", 0
        for a, b, r in sorted(edits):
            if a >= at:
                out, at = out + text[at:a] + r, b
        assert got[k] == out + text[at:], (text, edits)


@pytest.mark.parametrize("sent", [True, False])
def test_literals_against_plain_search(spark, monkeypatch, sent):
    monkeypatch.setattr(L, "SENT_ROWS", 100_000 if sent else 0)
    import regex

    rng = random.Random(6)
    words = ["Anna", "Ek", "ek", "Björk", "och", "AB", "42", "_x", "Annas", "(", "é"]
    docs = [(k, "".join(rng.choice(words) + rng.choice([" ", "", ", ", "s ", "-"]) for _ in range(rng.randrange(0, 40)))) for k in range(80)]
    values = ["Anna", "Anna Ek", "Ek", "AB 42", "(", "42", "och Björk", "_x", "Ek, Ek", "é"]
    literals = spark.createDataFrame([(v, "k") for v in values], "value string, kind string")
    got = sorted((r.doc_id, r.start, r.value) for r in L.find_literals(spark.createDataFrame(docs, "doc_id long, text string"), literals, suffixes=("s",)).collect())
    want = []
    for doc, text in docs:
        for v in values:
            left = r"(?<![\p{L}\p{N}_])" if regex.match(r"[\p{L}\p{N}_]", v) else ""
            right = r"(?:s)?(?![\p{L}\p{N}_])" if regex.search(r"[\p{L}\p{N}_]$", v) else ""
            want += [(doc, m.start(), v) for m in regex.finditer(f"{left}(?={regex.escape(v)}{right})", text)]
    assert got == sorted(want) and len(got) > 200


def test_sentences_begin_after_any_white_space(spark):
    rows = [("." + " " * 500 + "Anna", True), ("x" + " " * 500 + "Anna", False), (" " * 500 + "Anna", True), ("x," + "\t" * 90 + "Anna", False), ("(" + " " * 200 + "Anna", True)]
    df = spark.createDataFrame([(t, t.index("Anna"), w) for t, w in rows], "text string, at long, want boolean")
    assert all(r.want == r.got for r in df.select("want", D.sentence_initial(F.col("text"), F.col("at")).alias("got")).collect())
    # A word of everyday language is trusted in the middle of a sentence only.
    dictionary = spark.createDataFrame([("Björn", "given_wordlike")], "term string, class string")
    docs = spark.createDataFrame([(1, "Ja." + " " * 300 + "Björn vaknar"), (2, "ja, " + " " * 300 + "Björn vaknar")], "doc_id long, text string")
    assert [r.doc_id for r in D.name_spans(docs, dictionary).collect()] == [2]


def test_kinds_that_collide_many_times(spark):
    """Tokens of K, K1, K11 and so on are alike for many numbers; each value has one of its own in the end."""
    kinds = ["K" + "1" * n for n in range(12)]
    new = spark.createDataFrame([("p", f"{k}v{i}", k, n * 100 + i) for n, k in enumerate(kinds) for i in range(25)], "project_id string, value string, kind string, mint_order long")
    taken = spark.createDataFrame([("p", "K3"), ("p", "K112")], "project_id string, token string")
    got = [r.token for r in tokens.mint(new, taken, "kindNumber").collect()]
    assert len(got) == len(set(got)) == 300 and not {"K3", "K112"} & set(got)


def test_tokens_that_were_minted(spark):
    for style in placeholders.STYLES:
        df = spark.range(1, 40).select(placeholders.format_placeholder(style, F.col("id"), F.lit("a1 b")).alias("t"), "id")
        got = [r.ok for r in df.select(tokens.was_minted_for(F.col("t"), style, F.lit("a1 b"), F.lit(30)).alias("ok"), "id").orderBy("id").collect()]
        assert got == [k <= 30 for k in range(1, 40)], style
        odd = spark.createDataFrame([("",), ("x",), ("A1B0",), ("$01",), ("[A1B 1",), ("{{a1b}}",)], "t string")
        assert not any(r.ok for r in odd.select(tokens.was_minted_for(F.col("t"), style, F.lit("a1 b"), F.lit(10**6)).alias("ok")).collect() if r.ok)



def test_clusters_that_batches_cut_are_resolved_without_lists(spark):
    rows = [(d, at, at + 3 + at % 2, "", "k", "", at % 3, at) for d in range(3) for at in [*range(0, 9, 2), 20, *range(30, 33)]]
    df = spark.createDataFrame(rows, "doc_id long, start long, end long, value string, kind string, source string, priority int, seq int")
    own = F.collect_list(F.struct("start", "end", "value", "kind", "source", "priority", "seq"))
    want = sorted((r.doc_id, s.start) for r in df.groupBy("doc_id").agg(S.resolve(own.cast(SPANS)).alias("s")).collect() for s in r.s)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = S.resolved(df, ("doc_id",))
        assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id, r.start) for r in found.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
