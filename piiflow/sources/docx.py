"""Word packages as Markdown.

A helper flattens a package's XML to rows, in document order: paragraphs with their runs, styles, list
formats. What they mean together, headings, lists, tables, emphasis, headers, is joins and grouped
arrays of these rows.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.functions.text import html_comment

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Elements without text of the document.
_NOT_TEXT = frozenset(_W + x for x in "pPr rPr tblPr trPr tcPr tblGrid sectPr sdtPr sdtEndPr del instrText proofErr".split())
_OFF = ("0", "false", "off")
_ROWS = "name string, kind string, part string, seq int, style string, num string, depth int, outline int, tbl int, row int, cell int, runs string, a string, b string"


def _flat(name: str, content: bytes) -> Iterator[tuple]:
    """Rows of one package: par, style, format and num; runs are JSON lists of (text, bold, italic, style)."""

    def attr(element, tag: str, at: str = "val"):
        found = element.find(_W + tag) if element is not None else None
        return None if found is None else found.get(_W + at, "")

    def toggle(props, tag):
        value = attr(props, tag)
        return None if value is None else value not in _OFF

    def runs(element, out, props=None):
        for x in element:
            if x.tag in _NOT_TEXT:
                continue
            if x.tag == _W + "r":
                runs(x, out, x.find(_W + "rPr"))
                continue
            text = {_W + "t": x.text or "", _W + "tab": " ", _W + "br": "\n", _W + "cr": "\n", _W + "noBreakHyphen": "-"}.get(x.tag)
            if text is None:
                runs(x, out, props)
            else:
                out.append((text, toggle(props, "b"), toggle(props, "i"), attr(props, "rStyle")))
        return out

    def paragraphs(element, at=(None, None, None)):
        for x in element:
            if x.tag == _W + "p":
                yield x, at
            elif x.tag == _W + "tbl":
                tables.append(x)
                for r, row in enumerate(x.iter(_W + "tr")):
                    for c, cell in enumerate(row.iter(_W + "tc")):
                        for p in cell.iter(_W + "p"):
                            yield p, (len(tables), r, c)
            elif x.tag not in _NOT_TEXT:
                yield from paragraphs(x, at)

    with zipfile.ZipFile(BytesIO(content)) as package:
        names = set(package.namelist())
        if "word/document.xml" not in names:
            raise ValueError("no main part")
        part = lambda n: ElementTree.fromstring(package.read(n))
        if "word/styles.xml" in names:
            for s in part("word/styles.xml").iter(_W + "style"):
                props, numbered = s.find(_W + "rPr"), s.find(f"{_W}pPr/{_W}numPr")
                place = json.dumps([toggle(props, "b") or False, toggle(props, "i") or False])
                yield name, "style", s.get(_W + "type"), 0, s.get(_W + "styleId"), attr(numbered, "numId"), int(attr(numbered, "ilvl") or 0), None, None, None, None, place, attr(s, "name") or "", None
        if "word/numbering.xml" in names:
            root = part("word/numbering.xml")
            for d in root.iter(_W + "abstractNum"):
                for level in d.findall(_W + "lvl"):
                    yield name, "format", None, 0, None, None, int(level.get(_W + "ilvl") or 0), None, None, None, None, None, d.get(_W + "abstractNumId"), attr(level, "numFmt")
            for n in root.iter(_W + "num"):
                yield name, "num", None, 0, None, n.get(_W + "numId"), None, None, None, None, None, None, attr(n, "abstractNumId"), None
        furniture = sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
        seq = 0
        for p in [n for n in furniture if "header" in n] + ["word/document.xml"] + [n for n in furniture if "footer" in n]:
            tables: list = []
            root = part(p)
            body = root if p != "word/document.xml" else root.find(_W + "body")
            if body is None:
                raise ValueError("no body")
            for x, (t, r, c) in paragraphs(body):
                props = x.find(_W + "pPr")
                numbered = props.find(_W + "numPr") if props is not None else None
                outline = attr(props, "outlineLvl")
                seq += 1
                yield (
                    name, "par", "body" if p == "word/document.xml" else p[5:11], seq, attr(props, "pStyle"), attr(numbered, "numId"),
                    int(attr(numbered, "ilvl") or 0), None if outline is None else int(outline), t, r, c, json.dumps(runs(x, [])), None, None,
                )


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    whole = {c: "Int32" for c in ("seq", "depth", "outline", "tbl", "row", "cell")}
    for frame in frames:
        for name, content in zip(frame["name"], frame["content"]):
            try:
                rows = list(_flat(name, content))
            except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, EOFError) as e:
                rows = [(name, "error", None, 0, None, None, None, None, None, None, None, None, str(e), None)]
            yield pd.DataFrame(rows or [(name, "none", *[None] * 12)], columns=columns).astype(whole)


def _emphasised(run: Column, emphatic: Column) -> Column:
    core = F.regexp_extract(run["text"], r"(?s)^\s*(.*?)\s*\z", 1)
    lead, trail = F.regexp_extract(run["text"], r"^\s*", 0), F.regexp_extract(run["text"], r"\s*\z", 0)
    italic = F.when(emphatic & run["italic"], F.concat(F.lit("*"), core, F.lit("*"))).otherwise(core)
    bold = F.when(emphatic & run["bold"], F.concat(F.lit("**"), italic, F.lit("**"))).otherwise(italic)
    return F.when(core == "", run["text"]).otherwise(F.concat(lead, bold, trail))


def extract(files: DataFrame) -> DataFrame:
    """files(name, content) as name, text (Markdown) and status: ok, empty or failed."""
    rows = files.select("name", "content").mapInPandas(_rows, _ROWS)
    shape = "array<array<string>>"
    styles = rows.filter("kind = 'style'").select(
        F.col("name").alias("_sname"), F.col("style").alias("_style"), F.col("part").alias("_type"), F.col("num").alias("_snum"), F.col("depth").alias("_sdepth"), F.from_json("runs", "array<boolean>").alias("_face"),
        F.coalesce(
            F.nullif(F.regexp_extract("a", r"(?i)^heading[\s_-]*([1-9])$", 1), F.lit("")), F.nullif(F.regexp_extract("style", r"(?i)^heading[\s_-]*([1-9])$", 1), F.lit("")),
            F.when(F.rlike("a", F.lit("(?i)^title$")), "1"), F.when(F.rlike("a", F.lit("(?i)^subtitle$")), "2"),
        ).cast("int").alias("_level"),
    )
    formats = rows.filter("kind = 'format'").select("name", F.col("a").alias("_abstract"), F.col("depth").alias("_fdepth"), F.col("b").alias("_format"))
    formats = rows.filter("kind = 'num'").select("name", F.col("num").alias("_fnum"), F.col("a").alias("_abstract")).join(formats, ["name", "_abstract"]).drop("_abstract")
    pars = rows.filter("kind = 'par'").select("name", "part", "seq", "style", "num", "depth", "outline", "tbl", "row", "cell", F.from_json("runs", shape).alias("_runs"))
    # Faces: direct formatting before the run's style; adjacent runs of one face are one.
    runs = pars.select("name", "seq", F.posexplode("_runs").alias("_at", "_r"))
    runs = runs.select("name", "seq", "_at", F.get("_r", 0).alias("text"), F.get("_r", 1).alias("_b"), F.get("_r", 2).alias("_i"), F.get("_r", 3).alias("_rs"))
    faces = styles.filter("_type = 'character'").select(F.col("_sname").alias("name"), F.col("_style").alias("_rs"), "_face")
    runs = runs.join(faces, ["name", "_rs"], "left")
    face = lambda c, k: F.coalesce(F.col(c).cast("boolean"), F.get("_face", k), F.lit(False))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "text", face("_b", 0).alias("bold"), face("_i", 1).alias("italic"))))
    runs = runs.groupBy("name", "seq").agg(ordered.alias("_s"))
    merged = "array<struct<text:string,bold:boolean,italic:boolean>>"

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        new = F.struct(x["text"].alias("text"), x["bold"].alias("bold"), x["italic"].alias("italic"))
        joined = F.struct(F.concat(last["text"], x["text"]).alias("text"), x["bold"].alias("bold"), x["italic"].alias("italic"))
        same = (F.size(acc) > 0) & (last["bold"] == x["bold"]) & (last["italic"] == x["italic"])
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.array_append(acc, new))

    runs = runs.withColumn("_s", F.aggregate("_s", F.array().cast(merged), merge))
    plain = F.array_join(F.transform("_s", lambda r: r["text"]), "")
    pars = pars.drop("_runs").join(runs, ["name", "seq"]).withColumn("_plain", plain)
    inked = lambda c: F.filter(c, lambda r: F.trim(F.regexp_replace(r["text"], r"\s", "")) != "")
    whole = pars.filter("part = 'body'").groupBy("name").agg(F.flatten(F.collect_list(inked("_s"))).alias("_ink"))
    whole = whole.select("name", (~((F.size("_ink") > 0) & F.forall("_ink", lambda r: r["bold"]))).alias("_emphatic"))
    pars = pars.join(styles.filter("_type <> 'character'"), (F.col("name") == F.col("_sname")) & (F.col("style") == F.col("_style")), "left")
    pars = pars.join(whole, "name", "left").withColumn("_emphatic", F.coalesce("_emphatic", F.lit(True)))
    pars = pars.withColumns({"_num": F.coalesce("num", "_snum"), "_depth": F.when(F.col("num").isNotNull(), F.col("depth")).otherwise(F.col("_sdepth"))})
    formats = formats.withColumnRenamed("name", "_fname")
    pars = pars.join(formats, (F.col("name") == F.col("_fname")) & (F.col("_num") == F.col("_fnum")) & (F.col("_depth") == F.col("_fdepth")), "left")
    listed = F.col("_num").isNotNull() & (F.col("_num") != "0")
    marker = F.when(F.coalesce("_format", F.lit("bullet")) == "bullet", "- ").otherwise("1. ")
    level = F.when(listed, 0).otherwise(F.coalesce("_level", F.when(F.col("outline").isNotNull(), F.least(F.col("outline") + 1, F.lit(6))), F.lit(0)))
    body = F.trim(F.array_join(F.transform("_s", lambda r: _emphasised(r, F.col("_emphatic"))), ""))
    one_line = lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")
    block = (
        F.when(F.col("part") != "body", html_comment(F.col("_plain"))).when(F.col("tbl").isNotNull(), F.replace(one_line(body), F.lit("|"), F.lit("\\|")))
        .when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim(one_line(F.col("_plain")))))
        .when(listed, F.concat(F.repeat(F.lit("  "), F.col("_depth")), marker, one_line(body))).otherwise(body)
    )
    blocks = pars.select("name", "part", "seq", "tbl", "row", "cell", block.alias("block"), (F.trim(F.regexp_replace("_plain", r"\s", "")) != "").alias("_said"))
    # Tables: cells of a row, rows of a table, padded to the widest row.
    cells = blocks.filter("tbl IS NOT NULL").groupBy("name", "tbl", "row", "cell").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("seq", "_said", "block"))), lambda x: x["_said"]), lambda x: x["block"]), " ").alias("text"))
    lines = cells.groupBy("name", "tbl", "row").agg(F.min("seq").alias("seq"), F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]).alias("cells"))
    table = lines.groupBy("name", "tbl").agg(F.min("seq").alias("seq"), F.max(F.size("cells")).alias("_w"), F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.concat(cells, F.array_repeat(F.lit(""), F.col("_w") - F.size(cells))), " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), F.col("_w")))
    drawn = F.transform("rows", line)
    tables = table.select("name", "seq", F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, F.lit(2), F.size(drawn))), "\n").alias("block"))
    # A header or footer that several sections repeat is written once.
    furniture = blocks.filter("part <> 'body' AND _said").groupBy("name", "part", "block").agg(F.min("seq").alias("seq")).select("name", "seq", "block")
    plain_blocks = blocks.filter("part = 'body' AND tbl IS NULL AND _said").select("name", "seq", "block")
    text = tables.unionByName(furniture).unionByName(plain_blocks).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("seq", "block"))).alias("_b"))
    text = text.select("name", F.trim(F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n")).alias("text"))
    failed = rows.groupBy("name").agg(F.max(F.when(F.col("kind") == "error", 1).otherwise(0)).alias("_failed"))
    status = F.when(F.col("_failed") == 1, "failed").when(F.coalesce("text", F.lit("")) == "", "empty").otherwise("ok")
    return failed.join(text, "name", "left").select("name", "text", status.alias("status"))
