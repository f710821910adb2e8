import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from piiflow.sources import docx, files, layout, stores
from piiflow.streaming.masking import StreamingMasker

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(**parts):
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(f"word/{name}.xml", body)
    return out.getvalue()


def test_word_packages_become_markdown(spark):
    document = f"""<w:document {W}><w:body>
      <w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Heading</w:t></w:r></w:p>
      <w:p><w:r><w:t xml:space="preserve">Some </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> text</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>
      <w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
    </w:body></w:document>"""
    styles = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="3"><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="3"/></w:num></w:numbering>'
    header = f"<w:hdr {W}><w:p><w:r><w:t>Court</w:t></w:r></w:p></w:hdr>"
    good = package(document=document, styles=styles, numbering=numbering, header1=header, header2=header)
    rows = [("good.docx", good, None), ("bad.docx", b"no zip", None), ("old.doc", b"", None), ("a.TXT", "x\r\ny".encode(), None), ("b.md", b"  ", None), ("c.bin", b"", None)]
    got = {r.name: r for r in files.intake(spark.createDataFrame(rows, "name string, content binary, mime string")).collect()}
    assert {k: v.status for k, v in got.items()} == {"good.docx": "ok", "bad.docx": "failed", "old.doc": "legacy", "a.TXT": "ok", "b.md": "empty", "c.bin": "unsupported"}
    assert got["a.TXT"].text == "x\ny"
    assert got["good.docx"].text == "<!-- Court -->\n\n# Heading\n\nSome **bold** text\n\n  1. item\n\n| a\\|b | c |\n| --- | --- |\n| d |  |"
    entries = files.zip_entries(spark.createDataFrame(rows[:2], "name string, content binary, mime string")).collect()
    assert len(entries) == 6 and sum(e.error is not None for e in entries) == 1
    assert docx.extract(spark.createDataFrame([], "name string, content binary")).count() == 0


def runs(spark, pages):
    rows = [(1, p, k, text, 70.0, y, width, 12.0, True, False, False) for p, page in enumerate(pages) for k, (text, y, width) in enumerate(page)]
    return spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, x double, y double, width double, height double, has_eol boolean, bold boolean, italic boolean")


def test_pages_become_one_text(spark):
    page = lambda k, *text: [(f"Sida {k}", 800.0, 40.0), *[(t, 700.0 - 14 * i, 400.0) for i, t in enumerate(text)]]
    pages = [page(1, "First line of it", "that goes on with-", "out an end and"), page(2, "continues here.", "Second line. More"), page(3, "and more of it", "until the end.")]
    text = layout.markdown(runs(spark, pages)).first().markdown
    assert "First line of it that goes on without an end and continues here." in text
    assert text.count("<!-- Sida") == 3


def test_faces_inside_of_lines(spark):
    rows = [
        ("Some ", 0, 700, False, False), ("bold", 25, 700, True, False), (" and  ", 45, 700, False, False), ("slanted text that goes on", 70, 700, False, True),
        ("over the end", 0, 686, False, True), ("and both", 100, 686, True, True), (".", 140, 686, False, False),
        ("•  ", 0, 640, False, False), ("item", 12, 640, True, False), (" plain", 40, 640, False, False), ("Short heading", 0, 600, True, False),
    ]
    width = lambda t: 5.0 * len(t)
    rows = [(1, 0, k, t, float(x), float(y), width(t) if y != 700 else (width(t) if x < 70 else 400.0), 12.0, False, b, i) for k, (t, x, y, b, i) in enumerate(rows)]
    schema = "doc_id long, page int, seq int, text string, x double, y double, width double, height double, has_eol boolean, bold boolean, italic boolean"
    got = layout.markdown(spark.createDataFrame(rows, schema)).first().markdown
    assert got == "Some **bold** and *slanted text that goes on over the end* ***and both***.\n\n- **item** plain\n\n### Short heading"
    # All of a document in bold has nothing to set off.
    bold = layout.markdown(spark.createDataFrame([r[:9] + (True, r[10]) for r in rows], schema)).first().markdown
    assert "*" not in bold and bold.startswith("Some bold and slanted text")


def test_names_of_faces(spark):
    rows = [("ABCDEF+Sans-BoldItalic", None, None), ("Sans-Oblique", None, None), ("BOLDER+Sans", None, None), (None, True, None), ("Sans", None, True), ("Arial Black", False, False)]
    df = spark.createDataFrame(rows, "face string, bold boolean, italic boolean")
    got = [tuple(r.s) for r in df.select(layout.font_style(F.col("face"), F.col("bold"), F.col("italic")).alias("s")).collect()]
    assert got == [(True, True), (False, True), (False, False), (True, False), (False, True), (True, False)]


def test_a_stream_keeps_its_tokens(spark, tmp_path):
    schema = "project_id string, doc_id long, text string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    masker = StreamingMasker(out)
    first = spark.createDataFrame([("p", 1, "a@x.se och b@x.se")], schema)
    second = spark.createDataFrame([("p", 2, "c@x.se och a@x.se")], schema)
    for number, docs in enumerate((first, second)):
        docs.write.mode("append").parquet(source)
        query = masker.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "ck"))
        query.awaitTermination()
        assert query.exception() is None
    got = {r.doc_id: r.text for r in spark.read.parquet(f"{out}/masked").collect()}
    assert got == {1: "EMAIL1 och EMAIL2", 2: "EMAIL3 och EMAIL1"}
    masker.batch(second, 1)  # a replay
    assert spark.read.parquet(f"{out}/variables").count() == 3
    assert {r.doc_id: r.text for r in spark.read.parquet(f"{out}/masked").collect()} == got
    assert masker.variables(spark, 1).agg(F.count("*")).first()[0] == 2


def test_what_is_stored_comes_back(spark, tmp_path):
    body = lambda k: '{"version":1,"projects":[{"id":"p%d","name":"x"}]}' % k
    writes = spark.createDataFrame([("a", body(1), 1), ("a", body(2), 2), ("b", "{broken", 1), ("c", "", 1)], "workspace string, body string, version long")
    path = str(tmp_path / "stored")
    stores.save_workspaces(writes, path)
    got = {r.workspace: r for r in stores.load_workspaces(spark, path).collect()}
    assert {k: v.status for k, v in got.items()} == {"a": "ok", "b": "unreadable", "c": "blank"} and got["a"].active_id == "p2"
    # A later write of one workspace leaves the others as they are.
    stores.save_workspaces(spark.createDataFrame([("a", body(3), 3)], writes.schema), path)
    got = {r.workspace: r.active_id for r in stores.load_workspaces(spark, path).collect()}
    assert got == {"a": "p3", "b": None, "c": None}
    docs = spark.createDataFrame([("Brev: 1?.docx", "# Hej"), ("..", "x")], "name string, text string")
    stores.save_markdown(docs, str(tmp_path / "out"), ".md")
    assert {r.document for r in spark.read.text(str(tmp_path / "out")).select("document").distinct().collect()} == {"Brev- 1-.md", "document.md"}
    stores.save_table(docs, str(tmp_path / "vault"))
    assert spark.read.parquet(str(tmp_path / "vault")).count() == 2


def test_pasted_texts(spark):
    df = spark.createDataFrame([("  ", "text"), (None, "more"), ("named", " \n\t"), ("named", " x ")], "name string, text string")
    assert sorted((r.name, r.text) for r in files.pasted(df).collect()) == [("Untitled", "more"), ("Untitled", "text"), ("named", " x ")]


def test_a_documents_lines_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, p, 0, f"Sida {p}", 70.0, 780.0, 40.0, 9.0, False, False, False) for p in range(3)], "doc_id long, page int, seq int, text string, x double, y double, width double, height double, has_eol boolean, bold boolean, italic boolean")
    found = layout.furniture(layout.lines(df, whole=True))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert [r.furniture for r in found.collect()] == ["head"] * 3


def test_faces_are_packed_and_unpacked(spark):
    df = spark.createDataFrame([([("a", True, False), ("\U0001f600", True, False)],), ([("a", False, True), ("b", True, True), (" ", False, False)],)], "c array<struct<c:string,b:boolean,i:boolean>>")
    got = df.select("c", layout.packed(F.col("c")).alias("f")).select("c", "f", layout.unpacked(layout.spelled(F.col("c")), F.col("f")).alias("back")).collect()
    assert [r.f for r in got] == ["1", "230"] and all(r.c == r.back for r in got)
