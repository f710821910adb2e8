"""What stands beside a candidate and where its document lies change the forest's verdict."""

import random

import pytest

from piiflow.llm import secret_scans


@pytest.fixture(scope="module")
def scanner(spark):
    rng = random.Random(12)
    parts = "ing tion er the and con re pro ment al ous ble est for with sun lock ware tree gen form data net port ver".split()
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(1500)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(vocabulary) for _ in range(200))) for k in range(80)], "doc_id long, text string")
    language = secret_scans.learn(docs)
    findings = secret_scans.labelled_findings(spark, language)
    return language, secret_scans.train(findings, language), findings


def probabilities(spark, scanner, rows):
    docs = spark.createDataFrame([(k, path, text) for k, (path, text) in enumerate(rows)], "doc_id long, source string, text string")
    found = {r.doc_id: r.probability for r in secret_scans.scan(docs, scanner[1], scanner[0]).collect()}
    return [found[k] for k in range(len(rows))]


def test_path_and_neighbours_count(spark, scanner):
    rng = random.Random(5)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (32, 40, 64) for _ in range(4)] + ["".join(rng.choice("abcdefghk0123456789") for _ in range(8)) for _ in range(12)]
    here = probabilities(spark, scanner, [("src0", f"set password={v} there") for v in values])
    there = probabilities(spark, scanner, [("tests/fixtures/example.py", f"set password={v} there") for v in values])
    after = probabilities(spark, scanner, [("src0", f"set password={v} example") for v in values])
    assert sum(a - b for a, b in zip(here, there)) / len(values) > 0.01 and max(a - b for a, b in zip(here, there)) > 0.05
    assert sum(a - b for a, b in zip(here, after)) / len(values) > 0.01
    digests = [v for v in values if len(v) >= 32]
    alone = probabilities(spark, scanner, [("src0", f"set token={v} there") for v in digests])
    named = probabilities(spark, scanner, [("src0", f"in commit {v} there") for v in digests])
    assert all(a >= 0.5 > b for a, b in zip(alone, named))


def test_words_beside_are_read_whole(spark):
    long = "w" * 50_000
    rows = [(1, f"checksum{long} password=abcdefgh1 \n\t {long}digest"), (2, f"a{' ' * 5000}token=abcdefgh2{chr(10) * 5000}b"), (3, "secret: abcdefgh3")]
    got = {r.doc_id: (r.before, r.after) for r in secret_scans.candidates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source")).collect()}
    assert got == {1: ("checksum" + long, long + "digest"), 2: ("a", "b"), 3: ("", "")}


def test_labels_by_kind(spark, scanner):
    rows = scanner[2].collect()
    assert len(rows) > 7500 and {r.secret for r in rows} == {0, 1}
    share = lambda y: sum(r.path in secret_scans.EXAMPLE_PATHS for r in rows if r.secret == y) / sum(r.secret == y for r in rows)
    assert 0.45 < share(0) < 0.6 and 0.05 < share(1) < 0.11
