"""The stages over planted documents, and that each decision takes effect."""

import random

import corpus_pipeline


def test_stages_over_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))
    passage, line = prose(2), "A line of licence text that every document repeats."
    docs = [(k, prose(400 if k == 4 else 12)) for k in range(30)]
    docs += [(30, docs[3][1]), (31, docs[4][1].replace(".", "!", 1)), (32, "short text"), (33, "Buy now " * 200), (34, prose(6) + " " + passage), (35, None)]
    docs += [(40 + k, prose(9) + "\n" + line) for k in range(4)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        df = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r.doc_id: r for r in df.collect()})
        if k < 4:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {k for k, _ in docs}
    assert set(kept[0]) == everything - {32, 33, 35}
    assert set(kept[1]) == set(kept[0]) and sum(line in r.text for r in kept[1].values()) == 1 and line in kept[1][43].text
    # The lengths of texts follow what the stage left of them.
    assert all(r.n_chars == len(r.text) for r in kept[1].values()) and any(r.text != kept[0][k].text for k, r in kept[1].items())
    assert set(kept[1]) - set(kept[2]) == {30, 31}
    assert set(kept[2]) - set(kept[3]) == {34}
    assert set(kept[4]) <= set(kept[3]) and all(0 < r.taken <= 2 * r.size for r in kept[4].values())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in kept[4].values())


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, hits string, N_Words long"


def odd_documents(spark, tmp_path, n=40):
    """Nulls in every column, empty and long texts, repeated rows and identifiers, clashing columns."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(n))
    one, other = prose(12), prose(12)
    rows = [(k, prose(10), "en", f"s{k % 3}", 1, 2, "h", 3) for k in range(n)]
    rows += [(100, one, "en", "s1", 1, 2, "h", 3)] * 3 + [(100, other, "en", "s1", 1, 2, "h", 3), (101, prose(5000), None, None, None, None, None, None)]
    rows += [(None, prose(12), None, None, None, None, None, None), (None, one, None, "s0", 5, 6, "h", 7), (None, None, None, None, None, None, None, None)]
    rows += [(102, None, "en", "s1", None, 1, None, 1), (103, "", "en", "", 0, 1, "", 1)]
    spark.createDataFrame([(1, prose(2)), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, None, None), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return spark.createDataFrame(rows, DOCS), one, other


def test_stages_over_odd_documents(spark, tmp_path):
    docs, one, other = odd_documents(spark, tmp_path)
    stages, n, want = dict(corpus_pipeline.STAGES), docs.count(), sorted(map(str, docs.collect()))
    good = stages["quality rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and sorted(map(str, good.collect())) == [x for x in want if "text=None" not in x and "text=''" not in x]
    lines = stages["line dedup"](spark, docs, str(tmp_path)).collect()
    assert len(lines) == n and sum(r.text == "" for r in lines) == 3
    left = stages["SimHash near-dedup"](spark, docs, str(tmp_path)).collect()
    by_id = {k: [r.text for r in left if r.doc_id == k] for k in (None, 100, 102, 103)}
    # Both texts of 100 are components of their own; the null text of 102 stands for the empty ones.
    # Of those without an identifier, one repeats a document that has one and one has no words; the other is no copy.
    assert sorted(by_id[100]) == sorted([one] * 3 + [other]) and by_id[102] == [None] and by_id[103] == []
    assert len(by_id[None]) == 1 and by_id[None][0] not in (one, None)
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == want
    mixed = stages["mixing sources"](spark, docs, str(tmp_path))
    rows = mixed.collect()
    assert all(r["size"] == len(r.text.split()) and 0 < r.taken <= 2 * r["size"] for r in rows) and len(rows) <= n
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    same = [r.taken for r in rows if r.text == one and r.doc_id == 100]
    assert len(same) <= 3 and max(same, default=0) - min(same, default=0) <= max(r["size"] for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_without_benchmark_and_labels(spark, tmp_path):
    docs, *_ = odd_documents(spark, tmp_path / "full", 5)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.taken > 0 for r in rows)
