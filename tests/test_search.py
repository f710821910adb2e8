"""Search through an index finds what search finds, in fewer files."""

import random

from piiflow.operators import search


def tables(spark, texts):
    projects = spark.createDataFrame([("p", "Alpha"), ("q", None)], "project_id string, name string")
    docs = spark.createDataFrame([("p" if i % 3 else None, i, "n", t) for i, t in enumerate(texts)], "project_id string, doc_id long, name string, text string")
    variables = spark.createDataFrame([("p", 1, "NAME1", "Alpha Ek"), ("q", 2, "NAME2", None)], "project_id string, variable_order long, token string, value string")
    return projects, docs, variables


def test_texts_that_match_in_any_case_fold_to_the_same(spark):
    """All letters with case: what the engine's patterns take for one sign, the index does too."""
    odd = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and (chr(c).lower() != chr(c) or chr(c).upper() != chr(c))]
    java = spark._jvm.java.lang.Character
    forms = {}
    for c in odd:
        forms.setdefault(java.toLowerCase(java.toUpperCase(ord(c))), set()).add(search.folded(c))
    assert [f for f in forms.values() if len(f) > 1] == []
    for part, text in [("ΑΣ", "ΑΣΒ"), ("ς", "aΣ b"), ("ß", "aẞb"), ("i", "xİy"), ("ſt", "aSTb")]:
        assert search.folded(part) in search.folded(text)


def test_trigrams_of_any_text():
    spelled = lambda text: {"".join(chr(g >> k & 0x1FFFFF) for k in (42, 21, 0)) for g in search.trigrams(text).tolist()}
    for text in ("abcab\nc", "ab", "", "ab" * 300_000 + "c", "a😀bc", "\U0010ffff" * 4):
        assert spelled(text) == {text.upper()[i : i + 3] for i in range(len(text) - 2)}


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    drawn = random.Random(4)
    word = lambda: "".join(drawn.choice("abÅſΣσς.") for _ in range(drawn.randint(1, 6)))
    texts = [" ".join(word() for _ in range(drawn.randint(0, 30))) for _ in range(150)] + [None, "", "same text"] + ["same text"] * 60 + ["x" * 5000 + "Needle"]
    p, d, v = tables(spark, texts)
    path = str(tmp_path / "index")
    search.write_index(search.searchable(p, d, v), path, block_chars=200)
    key = lambda rows: sorted((str(r.project_id), r.hit, r.item, r.clip, r.n_matches) for r in rows.collect())
    for query in ["alpha", "SAME", "needle", "åsσ", "a", "  ", "NAME1 = al"]:
        assert key(search.search_index(spark, path, query)) == key(search.search(p, d, v, query)), query


def test_files_read_shrink_with_the_query(spark, tmp_path):
    texts = [f"number {i} {'abcdefghij'[i % 10] * 3}" for i in range(100)] + ["one Rare word"]
    p, d, v = tables(spark, texts)
    path = str(tmp_path / "index")
    search.write_index(search.searchable(p, d, v), path, part_chars=400, block_chars=100)
    read = lambda q: len(search.candidates(spark, path, q).drop("_block").filter("text is not null").select("_folder").distinct().collect())
    everything = len(spark.read.parquet(f"{path}/texts").select("_folder").distinct().collect())
    assert read("number") > 5 and read("rare word") == 1 and read("/rare/") == everything
    plan = search.candidates(spark, path, "rare word")._jdf.queryExecution().executedPlan().toString()
    assert "_folder" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_index_of_nothing(spark, tmp_path):
    p, d, v = (t.limit(0) for t in tables(spark, ["x"]))
    search.write_index(search.searchable(p, d, v), str(tmp_path / "i"))
    assert search.search_index(spark, str(tmp_path / "i"), "word").count() == 0


def test_a_task_sorts_some_16_million_characters():
    """Folders become more as the texts do; a few of them, as hashing deals them, stay far below a task's memory."""
    assert search.PART_CHARS <= 1 << 24
