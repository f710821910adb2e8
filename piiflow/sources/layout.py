"""Positioned runs of pages as lines, paragraphs and Markdown, with windows and groups over pages.

runs: doc_id, page, seq (content order), text, x, y (up), width, height, has_eol, bold, italic. A page is the
largest group that is brought together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piiflow.functions.text import html_comment
from piiflow.operators.spans import let
from piiflow.sources.stores import materialize

# The geometry of lines and paragraphs, in points or as ratios.
SAME_LINE, GAP_RATIO = 2.0, 0.2
PARAGRAPH_GAP, INDENT, SHORT_LINE, BLOCK_DROP, BLOCK_RISE = 1.35, 0.4, 0.2, 3.0, 0.5
HEADING_RATIOS = (1.9, 1.45, 1.15)
BOLD_HEADING_CHARS = 90
FURNITURE_PAGES, FURNITURE_DEPTH, FURNITURE_Y = 3, 2, 2.0
DEFAULT_HEIGHT, DEFAULT_LEADING = 12.0, 1.6
SENTENCE_END = r"[.!?:;…][\"'”’)\]]*\s*\z"
LIST_MARKER = r"^(?:[•◦▪‣·*–-]\s|\(?[0-9]{1,3}[.)]\s|\(?[a-z][.)]\s)"
BULLET = r"^[•◦▪‣·*–—-]\s+"
# Names of faces that say what they look like, and the tag of a face that is kept in part.
BOLD_FACE, ITALIC_FACE, FACE_TAG = r"(?i)bold|heavy|(?:^|[-_,.\s])black(?![a-z])", "(?i)italic|oblique", "^[A-Z]{6}\\+"
_CHARS = "array<struct<c:string,b:boolean,i:boolean>>"
_BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def font_style(face: Column, bold: Column, italic: Column) -> Column:
    """Whether a run is bold and italic: by its flags, or by the name of its face without the tag of a part."""
    name = F.regexp_replace(F.coalesce(face, F.lit("")), FACE_TAG, "")
    has = lambda flag, pattern: F.coalesce(flag, F.lit(False)) | F.rlike(name, F.lit(pattern))
    return F.struct(has(bold, BOLD_FACE).alias("bold"), has(italic, ITALIC_FACE).alias("italic"))


def _set(text: Column, bold: Column, italic: Column) -> Column:
    """A text as characters, each with its face."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c"), bold.alias("b"), italic.alias("i")))


def _blank(char: Column) -> Column:
    return char["c"].isin(*_BLANKS)


def collapsed(chars: Column) -> Column:
    """Characters with each run of white space as one blank, in the face of what follows; none at the ends."""
    inked = lambda x: ~_blank(x)

    def cut(all_: Column) -> Column:
        follows = lambda i: F.get(all_, i + 1)
        # The last blank of a run stays, if ink follows it.
        kept = F.transform(all_, lambda x, i: F.when(inked(x), x).when(inked(follows(i)), F.struct(F.lit(" ").alias("c"), follows(i)["b"].alias("b"), follows(i)["i"].alias("i"))))
        return let(F.filter(kept, lambda x: x.isNotNull()), lambda k: F.when(_blank(F.get(k, 0)), F.slice(k, F.lit(2), F.size(k))).otherwise(k))

    return let(chars, cut)


def spelled(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda x: x["c"]), "")


def emphasised(chars: Column, emphatic: Column) -> Column:
    """Characters as Markdown: marks hug the ink of each stretch in one face. Not emphatic: no marks."""

    def marked(x: Column) -> Column:
        core = F.trim(x["t"])
        lead = F.substr(x["t"], F.lit(1), F.length(x["t"]) - F.length(F.ltrim(x["t"])))
        trail = F.substr(x["t"], F.length(F.rtrim(x["t"])) + 1)
        slanted = F.when(x["i"], F.concat(F.lit("*"), core, F.lit("*"))).otherwise(core)
        return F.when(core == "", x["t"]).otherwise(F.concat(lead, F.when(x["b"], F.concat(F.lit("**"), slanted, F.lit("**"))).otherwise(slanted), trail))

    def faced(all_: Column) -> Column:
        face = lambda x: F.struct(x["b"], x["i"])
        begins = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (face(F.get(all_, i)) != face(F.get(all_, i - 1))))

        def stretches(at: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(at, k + 1), F.size(all_))
            piece = lambda i, k: F.struct(spelled(F.slice(all_, i + 1, upto(k) - i)).alias("t"), F.get(all_, i)["b"].alias("b"), F.get(all_, i)["i"].alias("i"))
            return F.array_join(F.transform(F.transform(at, piece), marked), "")

        return let(begins, stretches)

    return F.when(F.size(chars) == 0, "").when(emphatic, let(chars, faced)).otherwise(spelled(chars))


def wrapped(parts: Column, faced: bool = True) -> Column:
    """Lines (text, chars) put together: a soft hyphen goes, after another one nothing comes, else a blank in the next line's face. Not faced: texts only."""
    soft = lambda a, b: F.rlike(a, F.lit(r"\p{Ll}[-\x{AD}]\z")) & F.rlike(b, F.lit(r"^\p{Ll}"))
    form = f"struct<text:string,chars:{_CHARS}>"

    def step(acc: Column, x: Column) -> Column:
        t = x["text"]
        make = lambda text, chars: F.struct(text.alias("text"), (chars(x["chars"]) if faced else acc["chars"]).alias("chars")).cast(form)
        blank = lambda c: F.array(F.struct(F.lit(" ").alias("c"), F.get(c, 0)["b"].alias("b"), F.get(c, 0)["i"].alias("i")))
        cut = make(F.concat(F.regexp_replace(acc["text"], r"[-\x{AD}]\z", ""), t), lambda c: F.concat(F.slice(acc["chars"], F.lit(1), F.size(acc["chars"]) - 1), c))
        joined = make(F.concat(acc["text"], F.lit(" "), t), lambda c: F.concat(acc["chars"], blank(c), c))
        hyphened = make(F.concat(acc["text"], t), lambda c: F.concat(acc["chars"], c))
        return F.when(acc["text"] == "", make(t, lambda c: c)).when(soft(acc["text"], t), cut).when(acc["text"].endswith("-"), hyphened).otherwise(joined)

    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.array().cast(_CHARS).alias("chars")).cast(form), step)


def _face(bold: Column, italic: Column) -> Column:
    """A face as a digit: 1 is bold, 2 italic."""
    return F.when(bold, F.when(italic, "3").otherwise("1")).otherwise(F.when(italic, "2").otherwise("0"))


def packed(chars: Column) -> Column:
    """The faces of characters as digits; one digit where all are alike."""
    digits = lambda all_: F.transform(all_, lambda x: _face(x["b"], x["i"]))
    return let(digits(chars), lambda d: F.when(F.size(F.array_distinct(d)) == 1, F.get(d, 0)).otherwise(F.array_join(d, "")))


def unpacked(text: Column, faces: Column) -> Column:
    """The characters of a text with faces as packed() has them."""
    set_ = lambda face, c: F.struct(c.alias("c"), face.isin("1", "3").alias("b"), face.isin("2", "3").alias("i"))
    of = lambda digits: F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: set_(F.when(F.length(faces) == 1, faces).otherwise(F.get(digits, i)), c))
    return let(F.split(faces, ""), of)


def _joined(parts: Column) -> Column:
    """wrapped() of (text, faces), with faces packed again: text and faces. Only texts are put together where all are in one face."""
    alike = lambda p: (F.size(F.array_distinct(p["faces"])) == 1) & (F.length(F.get(p["faces"], 0)) == 1)
    full = lambda p: wrapped(F.transform(p, lambda x: F.struct(x["text"].alias("text"), unpacked(x["text"], x["faces"]).alias("chars"))))
    plain = lambda p: F.struct(wrapped(F.transform(p, lambda x: F.struct(x["text"].alias("text"))), faced=False)["text"].alias("text"), F.get(p["faces"], 0).alias("faces"))
    return F.when(alike(parts), plain(parts)).otherwise(let(full(parts), lambda w: F.struct(w["text"].alias("text"), packed(w["chars"]).alias("faces"))))


def lines(runs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, page, line_no, text, left, right, y, height, bold, and chars: the text's characters with their faces (and faces, as packed() has them).

    A run goes on in the line if it is within 2 points of the line's first run and no line end came
    before; a gap over a fifth of the height, 1 point at least, is a blank. Empty lines are left out.
    whole: all pages of a document come to one task, so that nothing more is shuffled where documents are asked for.
    """
    no = F.lit(False)
    run = F.struct("seq", "text", "x", "y", "width", "height", F.coalesce("has_eol", no).alias("eol"), F.coalesce("bold", no).alias("bold"), F.coalesce("italic", no).alias("italic"))
    runs = runs.repartition("doc_id") if whole else runs
    pages = runs.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(run)).alias("_r"))

    def begins(acc: Column, r: Column) -> Column:
        goes_on = (acc["i"] > 0) & ~acc["eol"] & (F.abs(r["y"] - acc["y"]) <= SAME_LINE)
        at = F.when(goes_on, acc["at"]).otherwise(F.array_append(acc["at"], acc["i"]))
        return F.struct((acc["i"] + 1).alias("i"), at.alias("at"), F.when(goes_on, acc["y"]).otherwise(r["y"]).alias("y"), r["eol"].alias("eol"))

    begun = F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("eol"))
    parts = lambda at: F.transform(at, lambda k, i: F.slice("_r", k + 1, F.coalesce(F.get(at, i + 1), F.size("_r")) - k))

    def set_apart(acc: Column, r: Column) -> Column:
        gap = r["x"] - acc["right"] > F.greatest(F.lit(1.0), GAP_RATIO * r["height"])
        return F.struct(F.greatest(acc["right"], r["x"] + r["width"]).alias("right"), F.array_append(acc["out"], F.concat(F.when(gap, F.lit(" ")).otherwise(F.lit("")), r["text"])).alias("out"))

    def told(own: Column) -> Column:
        pieces = F.aggregate(own, F.struct(F.lit(None).cast("double").alias("right"), F.array().cast("array<string>").alias("out")), set_apart, lambda acc: acc["out"])
        text = lambda p: F.when(F.forall(p, lambda t: t.isNotNull()), F.trim(F.regexp_replace(F.array_join(p, ""), r"\s+", " ")))
        return let(pieces, lambda p: F.struct(text(p).alias("text"), p.alias("pieces"), own.alias("runs")))

    found = let(F.aggregate("_r", begun, begins, lambda acc: acc["at"]), lambda at: F.filter(F.transform(parts(at), told), lambda x: x["text"] != ""))
    rows = pages.select("doc_id", "page", F.posexplode(found).alias("_no", "_l")).select("doc_id", "page", "_no", "_l.*")
    inked = lambda r: F.trim(r["text"]) != ""
    chars = collapsed(F.flatten(F.zip_with("pieces", "runs", lambda t, r: _set(t, r["bold"], r["italic"]))))
    alike = F.array_distinct(F.transform("runs", lambda r: _face(r["bold"], r["italic"])))
    return rows.select(
        "doc_id", "page", (F.col("_no") + 1).cast("long").alias("line_no"), "text", F.array_min("runs.x").alias("left"), F.array_max(F.transform("runs", lambda r: r["x"] + r["width"])).alias("right"),
        F.get("runs", 0)["y"].alias("y"), F.array_max("runs.height").alias("height"), F.forall("runs", lambda r: r["bold"] | ~inked(r)).alias("bold"),
        chars.alias("chars"), F.when(F.size(alike) == 1, F.get(alike, 0)).otherwise(packed(chars)).alias("faces"),
    )


def common_left(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The most frequent left margin in whole points, the smaller of ties: the least left edge in it."""
    buckets = rows.groupBy(*by, half_up(F.col("left")).alias("_b")).agg(F.count("*").alias("_n"), F.min("left").alias("common_left"))
    first = Window.partitionBy(*by).orderBy(F.col("_n").desc(), "_b")
    return buckets.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(*by, "common_left")


def pitch(rows: DataFrame, by: tuple[str, ...], order: str = "line_no") -> DataFrame:
    """The usual distance of lines: the median of the most frequent 2-point bucket of drops, the smaller of ties.

    Fewer than three drops say nothing; then it is 1.6 times the median height.
    """
    w = Window.partitionBy(*by).orderBy(order)
    drops = rows.withColumn("_d", F.lag("y").over(w) - F.col("y"))
    heights = rows.groupBy(*by).agg((DEFAULT_LEADING * F.coalesce(F.nullif(F.median("height"), F.lit(0.0)), F.lit(DEFAULT_HEIGHT))).alias("_default"))
    drops = drops.filter("_d > 0").withColumn("_b", half_up(F.col("_d") / 2))
    buckets = drops.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.median("_d").alias("_m"))
    first = Window.partitionBy(*by).orderBy(F.col("_n").desc(), "_b")
    total = F.sum("_n").over(Window.partitionBy(*by))
    best = buckets.withColumns({"_k": F.row_number().over(first), "_all": total}).filter("_k = 1")
    return heights.join(best, list(by), "left").select(*by, F.when(F.col("_all") >= 3, F.col("_m")).otherwise(F.col("_default")).alias("pitch"))


def _middle(values: Column) -> Column:
    """The median of an array, as median() has it."""
    return let(F.sort_array(values), lambda v: F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) * 0.5 + F.get(v, F.floor(F.size(v) / 2).cast("int")) * 0.5)


def _commonest(values: Column, bucket: Callable[[Column], Column]) -> Column:
    """Those of an array in its most frequent bucket, the smaller of ties."""
    counted = F.transform(F.array_distinct(F.transform(values, bucket)), lambda b: F.struct((-F.size(F.filter(values, lambda v: bucket(v) == b))).alias("n"), b.alias("b")))
    return let(F.array_min(counted), lambda best: F.filter(values, lambda v: bucket(v) == best["b"]))


def _for_all(rows: DataFrame, by: Sequence[str], name: str, value: Callable[..., Column], *lists: Column) -> DataFrame:
    """rows with a value of the lists of their group (a page at most), told once for each group. Nothing is shuffled where a group's rows are in one task."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("line_no")
    held = rows.select("*", F.row_number().over(order).alias("_first"), *[F.collect_list(c).over(group).alias(f"_list{k}") for k, c in enumerate(lists)])
    once = F.when(F.col("_first") == 1, value(*[F.col(f"_list{k}") for k in range(len(lists))]))
    return held.select(*rows.columns, once.alias(name)).select(*rows.columns, F.max(name).over(group).alias(name))


def pitched(rows: DataFrame, by: Sequence[str], name: str = "pitch") -> DataFrame:
    """rows with the pitch() of their group, which a page holds."""
    drops = rows.withColumn("_drop", F.lag("y").over(Window.partitionBy(*by).orderBy("line_no")) - F.col("y"))

    def told(falls: Column, heights: Column) -> Column:
        usual = DEFAULT_LEADING * F.coalesce(F.nullif(_middle(heights), F.lit(0.0)), F.lit(DEFAULT_HEIGHT))
        return F.when(F.size(falls) >= 3, _middle(_commonest(falls, lambda d: half_up(d / 2)))).otherwise(usual)

    return _for_all(drops, by, name, told, F.when(F.col("_drop") > 0, F.col("_drop")), F.col("height")).drop("_drop")


def body_height(rows: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The height, in half points, of most characters; the smaller of ties."""
    buckets = rows.groupBy(*by, (half_up(F.col("height") * 2) / 2).alias("body_height")).agg(F.sum(F.length("text")).alias("_n"))
    first = Window.partitionBy(*by).orderBy(F.col("_n").desc(), "body_height")
    return buckets.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(*by, "body_height")


def furniture(rows: DataFrame) -> DataFrame:
    """rows (lines) with furniture: head, foot or null.

    A running header or footer: among the first or last two lines, at the same height with the same text but
    for digits on three pages or more, and clear of the body by more than a line.
    """
    own = Window.partitionBy("doc_id", "page")
    page = own.orderBy("line_no")
    back = page.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    key = F.concat_ws("|", half_up(F.col("y") / FURNITURE_Y).cast("string"), F.lower(F.regexp_replace("text", "[0-9]+", "#")))
    df = pitched(rows, ("doc_id", "page"))
    df = df.withColumns({"_top": F.row_number().over(page), "_all": F.count("*").over(own), "_key": key, "_next": F.lead("y").over(page), "_prev": F.lag("y").over(page)})
    df = df.withColumn("_end", F.col("_all") - F.col("_top") + 1)
    edge = (F.col("_top") <= FURNITURE_DEPTH) | (F.col("_end") <= FURNITURE_DEPTH)
    df = df.withColumn("_seen", F.count(F.when(edge, 1)).over(Window.partitionBy("doc_id", "_key")))
    often = F.col("_seen") >= FURNITURE_PAGES
    clear = lambda other: F.col(other).isNull() | (F.abs(F.col("y") - F.col(other)) > PARAGRAPH_GAP * F.col("pitch"))
    df = df.withColumns({"_h": often & clear("_next"), "_f": often & clear("_prev")})
    # From the edge inwards, each line only if those outside of it are furniture too.
    head = (F.col("_top") <= FURNITURE_DEPTH) & (F.min(F.col("_h").cast("int")).over(page) == 1)
    foot = (F.col("_end") <= FURNITURE_DEPTH) & (F.min(F.col("_f").cast("int")).over(back) == 1)
    return df.withColumn("furniture", F.when(head, "head").when(foot, "foot")).select(*rows.columns, "furniture")


def paragraphs(rows: DataFrame) -> DataFrame:
    """Lines as doc_id, page, block, par, text, height, lines, bold, chars: blocks in reading order, reflowed.

    chars are the text's characters with their faces. A block ends where the next line rises, or drops by over three pitches; blocks read from the top down,
    then from the left. In a block a paragraph ends at wider leading, before an indent, before a list item
    after a sentence, and at a line that stops well short of the right margin.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    rows = rows if "faces" in rows.columns else rows.withColumn("faces", packed(F.col("chars")))
    df = pitched(rows.drop("chars"), ("doc_id", "page"), "_pp")
    drop = F.lag("y").over(page) - F.col("y")
    new = (drop > BLOCK_DROP * F.col("_pp")) | (-drop > F.greatest(F.lit(2.0), BLOCK_RISE * F.col("_pp")))
    df = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    df = df.withColumn("_block", F.sum("_new").over(page))
    by = ("doc_id", "page", "_block")
    block = Window.partitionBy(*by)
    df = pitched(df, by, "_bp").withColumns({"_top": F.max("y").over(block), "_bleft": F.min("left").over(block), "_bright": F.max("right").over(block), "_lines": F.count("*").over(block)})
    df = _for_all(df, by, "common_left", lambda lefts: F.array_min(_commonest(lefts, half_up)), F.col("left"))
    # Few drops in a block say less than its page.
    df = df.withColumn("_pitch", F.when(F.col("_lines") > 3, F.col("_bp")).otherwise(F.col("_pp")))
    within = Window.partitionBy(*by).orderBy("line_no")
    before = lambda c: F.lag(c).over(within)
    slack = SHORT_LINE * F.greatest(F.col("_bright") - F.col("common_left"), F.lit(1.0))
    breaks = (
        (before("y") - F.col("y") > PARAGRAPH_GAP * F.col("_pitch")) | (F.col("left") - F.col("common_left") > INDENT * F.col("height"))
        | (F.rlike("text", F.lit(LIST_MARKER)) & F.rlike(before("text"), F.lit(SENTENCE_END))) | (before("right") < F.col("_bright") - slack)
    )
    df = df.withColumn("_p", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("_par", F.sum("_p").over(within))
    grouped = df.groupBy(*by, "_par").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text", "faces"))).alias("_l"), F.max("height").alias("height"), F.count("*").alias("lines"),
        F.min(F.col("bold").cast("int")).alias("_bold"), F.first("_top").alias("_top"), F.first("_bleft").alias("_bleft"),
    )
    grouped = grouped.withColumn("_w", _joined(F.col("_l")))
    order = Window.partitionBy("doc_id", "page").orderBy(-half_up(F.col("_top") / SAME_LINE), "_bleft", "_block")
    grouped = grouped.withColumn("block", F.dense_rank().over(order).cast("long"))
    return grouped.select("doc_id", "page", "block", F.col("_par").cast("long").alias("par"), "_w.text", "height", "lines", (F.col("_bold") == 1).alias("bold"), unpacked(F.col("_w.text"), F.col("_w.faces")).alias("chars"), "_w.faces")


def heading_level(height: Column, body: Column, lines_: Column, text: Column, bold: Column, emphatic: Column) -> Column:
    ratio = height / body
    level = F.when(body > 0, F.when(ratio >= HEADING_RATIOS[0], 1).when(ratio >= HEADING_RATIOS[1], 2).when(ratio >= HEADING_RATIOS[2], 3))
    short = emphatic & (lines_ == 1) & (F.length(text) <= BOLD_HEADING_CHARS) & ~F.rlike(text, F.lit(SENTENCE_END)) & bold
    return F.coalesce(level, F.when(short, 3).otherwise(0))


def markdown(runs: DataFrame) -> DataFrame:
    """doc_id and Markdown: headings by height or weight, lists, running lines as comments, pages joined.

    A paragraph that a page break cut, unfinished before it and beginning small after it, is put together.
    """
    # Lines are read many times over: they are written, not found anew. What follows asks for whole documents, which are shuffled once.
    rows = materialize(furniture(lines(runs, whole=True).drop("chars")))
    body = rows.filter("furniture IS NULL").drop("furniture")
    pars = paragraphs(body.repartition("doc_id")).drop("chars")
    sizes = body_height(body)
    faces = body.groupBy("doc_id").agg((F.min(F.col("bold").cast("int")) == 0).alias("_emphatic"))
    pars = pars.join(sizes, "doc_id").join(faces, "doc_id")
    level = heading_level(F.col("height"), F.col("body_height"), F.col("lines"), F.col("text"), F.col("bold"), F.col("_emphatic"))
    whole = Window.partitionBy("doc_id").orderBy("page", "block", "par")
    pars = pars.withColumns({"_level": F.when(F.rlike("text", F.lit(LIST_MARKER)), 0).otherwise(level)})
    pars = pars.withColumns({"_bt": F.lag("text").over(whole), "_bp": F.lag("page").over(whole), "_bl": F.lag("_level").over(whole)})
    goes_on = (F.col("_bp") < F.col("page")) & (F.col("_bl") == 0) & (F.col("_level") == 0) & ~F.rlike("_bt", F.lit(SENTENCE_END)) & F.rlike("text", F.lit(r"^[\p{Ll}(]"))
    pars = pars.withColumn("_n", F.sum(F.coalesce(~goes_on, F.lit(True)).cast("int")).over(whole))
    at = F.struct("page", "block", "par")
    joined = pars.groupBy("doc_id", "_n").agg(
        F.min(at).alias("_at"), F.min_by("_level", at).alias("_level"), F.min("_emphatic").alias("_emphatic"),
        F.sort_array(F.collect_list(F.struct("page", "block", "par", "text", "faces"))).alias("_l"),
    )
    joined = joined.withColumn("_w", _joined(F.col("_l"))).select("doc_id", "_at", "_level", "_emphatic", "_w.text", "_w.faces")
    # A bullet is drawn as Markdown has it, a heading without marks.
    bullet = F.length(F.regexp_extract("text", BULLET, 0))
    faced = let(unpacked(F.col("text"), F.col("faces")), lambda c: emphasised(F.slice(c, bullet + 1, F.greatest(F.size(c) - bullet, F.lit(0))), F.lit(True)))
    item = F.concat(F.when(bullet > 0, F.lit("- ")).otherwise(F.lit("")), F.when(F.col("_emphatic"), faced).otherwise(F.substr("text", bullet + 1)))
    drawn = F.when(F.col("_level") > 0, F.concat(F.repeat(F.lit("#"), F.col("_level")), F.lit(" "), F.col("text"))).otherwise(item)
    blocks = joined.select("doc_id", F.col("_at.page").alias("page"), F.lit(1).alias("part"), (F.col("_at.block") * 100000 + F.col("_at.par")).alias("k"), drawn.alias("text"))
    aside = rows.filter("furniture IS NOT NULL").select("doc_id", "page", F.when(F.col("furniture") == "head", 0).otherwise(2).alias("part"), F.col("line_no").alias("k"), html_comment(F.col("text")).alias("text"))
    both = blocks.unionByName(aside).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "part", "k", "text"))).alias("_b"))
    return both.select("doc_id", F.array_join(F.transform("_b", lambda x: x["text"]), "\n\n").alias("markdown"))
