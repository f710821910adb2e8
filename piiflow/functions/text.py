"""Regular-expression pieces that mean the same wherever a pattern runs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Java's \s knows ASCII only; this is all Unicode white space and the byte order mark.
SPACE = r"[\s\x{FEFF}\p{Z}]"
#: A word character of literals; detectors leave the underscore out.
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}])"
NOT_BEFORE_WORD_GENITIVE = r"(?=s?(?![\p{L}\p{N}]))"


def escape(literal: str) -> str:
    """A literal as a pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", literal)


def alternation(literals: Iterable[str]) -> str:
    """Many literals as one pattern, the longest first, common beginnings shared: a text is compared once, not with each."""
    root: dict = {}
    for literal in literals:
        at = root
        for c in literal:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        branches = [escape(c) + pattern(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return inner + ("?" if "" in node else "")

    return pattern(root)


def java_pattern(source: str, flags: str = "") -> str:
    r"""A user's pattern in the dialect of Java: \s, \b and $ as they are in Unicode mode there.

    Flags i, m and s become inline flags, y holds matches together from the start on; g, u and d change
    nothing about what is found.
    """
    out, at, inside = [], 0, False
    while at < len(source):
        c = source[at]
        if c == "\\" and at + 1 < len(source):
            two = source[at : at + 2]
            named = re.match(r"\\u\{([0-9A-Fa-f]+)\}", source[at:])
            if named:
                out.append(rf"\x{{{named[1]}}}")
                at += len(named[0])
                continue
            if two == r"\s":
                two = SPACE[1:-1] if inside else SPACE
            elif two == r"\S" and not inside:
                two = SPACE.replace("[", "[^", 1)
            elif two == r"\b" and not inside:
                two = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
            out.append(two)
            at += 2
            continue
        if c == "[" and not inside:
            inside = True
            if source[at : at + 3] == "[^]":
                out.append(r"[\s\S]")
                at, inside = at + 3, False
                continue
        elif c == "[":
            c = r"\["
        elif c == "]":
            inside = False
        elif c == "&" and inside:
            c = r"\&"
        elif c == "$" and not inside and "m" not in flags:
            c = r"\z"
        out.append(c)
        at += 1
    inline = "".join(f for f in "ims" if f in flags)
    prefix = f"(?{inline}{'u' if 'i' in inline else ''})" if inline else ""
    return (r"\G" if "y" in flags else "") + prefix + "".join(out)


def compile_pattern(spark: SparkSession, source: str, flags: str = "") -> str | None:
    """The pattern in Java's dialect, or None if it isn't one. A bad rule is skipped, and fails no job."""
    pattern = java_pattern(source, flags)
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return None
    return pattern


def matches_empty(spark: SparkSession, pattern: str) -> bool:
    """Whether a compiled pattern finds an empty match somewhere, which positions can't be told from."""
    compiled = spark._jvm.java.util.regex.Pattern.compile(pattern)
    return any(compiled.matcher(probe).find() and compiled.matcher(probe).replaceFirst("") == probe for probe in ("", "a", " ", "0-a.\n"))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def html_comment(text: Column) -> Column:
    """A text as a one-line comment; runs of hyphens are spaced out, as a comment can't hold them."""
    one_line = F.trim(F.regexp_replace(text, SPACE + "+", " "))
    body = F.regexp_replace(one_line, "-(?=-)", "- ")
    return F.when(body == "", F.lit("<!-- -->")).otherwise(F.concat(F.lit("<!-- "), body, F.lit(" -->")))


_COMMENT = r"^\s*<!--((?:(?!-->)[\s\S])*)-->\s*\z"


def is_comment_line(line: Column) -> Column:
    return F.rlike(line, F.lit(_COMMENT))


def comment_text(line: Column) -> Column:
    """What a comment says; any other line stands as it is."""
    return F.when(is_comment_line(line), F.trim(F.regexp_extract(line, _COMMENT, 1))).otherwise(line)


def file_extension(name: Column) -> Column:
    """From the last dot on, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))


def safe_stem(name: Column) -> Column:
    """A file name's stem without characters that file systems refuse. A dot in front begins no extension."""
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r'[\\/:*?"<>|]+', "-")
    stem = F.regexp_replace(stem, r"^[.\s]+|\s+$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("document"))


def folder_file_name(slug: Column, default: str = "default", base: str = "mask") -> Column:
    """A workspace's file; the default workspace has the bare name."""
    safe = F.regexp_replace(slug, "[^A-Za-z0-9_-]", "-")
    return F.when(slug == default, F.lit(f"{base}.json")).otherwise(F.concat(F.lit(f"{base}-"), safe, F.lit(".json")))
