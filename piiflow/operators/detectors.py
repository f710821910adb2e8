"""Detectors of Swedish personal data.

Six are patterns with a veto and run inside the row. Places are looked up by their words, or are a pattern where they are few,
and names join the words of capitalised runs to a dictionary. All give spans; overlaps are resolved later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piiflow.functions import checks
from piiflow.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, NOT_BEFORE_WORD_GENITIVE, SPACE, alternation, escape
from piiflow.operators.literals import find_literals
from piiflow.operators.spans import find_spans, matches, no_spans, pool
from piiflow.schema import SPAN

# What the detected things look like, by their public forms in Swedish.
PRIORITY = {"email": 9, "pin": 8, "org": 7, "postal": 6, "phone": 5, "street": 4, "city": 3, "name": 2}
ORDER = ("email", "pin", "org", "postal", "phone", "street", "city", "name")

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.[\p{L}]{2,}" + NOT_BEFORE_WORD
PIN = r"(?<![\p{N}])(?:[0-9]{2})?[0-9]{6}[-+]?[0-9]{4}" + NOT_BEFORE_WORD
ORG = rf"(?<![\p{{N}}-])(?:16)?[0-9]{{6}}(?:-|{SPACE})?[0-9]{{4}}" + NOT_BEFORE_WORD
_FIVE = rf"[1-9][0-9]{{2}}{SPACE}?[0-9]{{2}}"
POSTAL = rf"(?<![\p{{L}}\p{{N}}-])(?:SE-{SPACE}?{_FIVE}|(?<=[Pp]ost(?:nummer|nr)\.?:?{SPACE}{{0,3}}){_FIVE}|{_FIVE}(?={SPACE}{{1,2}}\p{{Lu}}\p{{L}}+))" + NOT_BEFORE_WORD
_GAP = rf"(?:-|{SPACE})?"
PHONE = rf"(?<![\p{{L}}\p{{N}}+])(?:\+46|0046|0){_GAP}\(?0?\)?{_GAP}[0-9](?:{_GAP}[0-9]){{5,10}}" + NOT_BEFORE_WORD

# Fixed values of streets: directions before, endings that suffice, endings that need a number.
DIRECTIONS = ("Norra", "Södra", "Östra", "Västra", "Gamla", "Nya", "Stora", "Lilla", "Övre", "Nedre", "Sankt", "Sankta", "St.", "S:t", "S:ta")
SAFE_ENDINGS = ("gatan", "gata", "vägen", "väg", "gränd", "gränden", "torget", "torg", "stigen", "stig", "allén", "allé", "stråket", "slingan", "terrassen", "promenaden", "esplanaden", "liden")
SAFE_WORDS = ("gata", "gatan", "väg", "vägen", "gränd", "torg", "allé", "allén", "stig", "stigen")
NUMBERED_ENDINGS = (
    "plan", "parken", "bron", "hamnen", "ringen", "leden", "led", "dalen", "hagen", "kullen", "holmen", "gården", "lunden", "ängen", "backen",
    "stranden", "vallen", "höjden", "udden", "kajen", "platsen", "plats",
)
NUMBERED_WORDS = ("plan", "led", "leden", "plats", "platsen")
# Words that end like a street and are none.
NOT_STREETS = (
    "Motorvägen", "Järnvägen", "Halvvägen", "Utvägen", "Genvägen", "Omvägen", "Avvägen", "Avväg", "Genväg", "Utväg", "Omväg", "Halvväg", "Motorväg",
    "Järnväg", "Sjukvägen", "Vandringsled", "Vandringsleden", "Cykelled", "Cykelleden", "Ledningen", "Anledningen", "Avledningen", "Inledningen",
    "Utredningen", "Överledningen", "Underliden", "Ledningsgruppen",
)
_DIRECTION = "(?:" + "|".join(map(escape, DIRECTIONS)) + ")" + SPACE
# Fixed value: a house number, its entrance, the end of a range and a flat. Its form leaves no choice for the same spans.
NUMBER = rf"{SPACE}[0-9]{{1,4}}(?:{SPACE}?[A-Za-z](?!\p{{L}}))?(?:{SPACE}?[-–]{SPACE}?[0-9]{{1,4}})?(?:,?{SPACE}(?:lgh|lägenhet)\.?{SPACE}?[0-9]{{3,4}})?"


def _street(endings: Sequence[str], words: Sequence[str], numbered: bool) -> str:
    """A street is one word, a beginning of three letters or more before an ending, or one or two words before a word of its own."""
    compound = r"\p{Lu}\p{L}{2,}(?:" + "|".join(endings) + ")"
    apart = r"(?:\p{Lu}\p{L}+" + SPACE + "){1,2}(?:" + "|".join(words) + ")"
    return NOT_AFTER_WORD + f"(?:{_DIRECTION})?(?:{compound}|{apart})" + (NUMBER if numbered else f"(?:{NUMBER})?") + NOT_BEFORE_WORD


STREETS = (_street(SAFE_ENDINGS, SAFE_WORDS, False), _street(NUMBERED_ENDINGS, NUMBERED_WORDS, True))
CAPITAL_RUN = rf"{NOT_AFTER_WORD}\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)?(?:[ \t]\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)?){{0,3}}{NOT_BEFORE_WORD}"

# Endings of surnames.
SURNAME_ENDINGS = (
    "sson", "son", "berg", "borg", "ström", "strom", "lund", "gren", "qvist", "quist", "kvist", "mark", "man", "dahl", "holm", "stedt", "ander", "én",
    "feldt", "vall", "wall", "hammar", "bäck", "strand", "blad", "löv", "sjö", "ius", "gård", "lind", "bom", "stam", "torp", "fors", "fält", "hed",
    "vik", "wik",
)
SURNAME_PATTERN = r"^(?=.{5,}\z)\p{Lu}\p{Ll}+\z"

#: A seed to start with. A real dictionary is a table of term and class, given by the caller.
SEED = {
    "given": ("Anna", "Erik", "Karin", "Lars", "Maria", "Johan", "Sara", "Anders", "Eva", "Nils", "Elsa", "Oskar", "Karl"),
    "given_wordlike": ("Björn", "Per", "Sten", "Stig", "Liv"),
    "surname": ("Svensson", "Lindqvist", "Nyberg", "Hallström", "Norén", "Ek"),
    "surname_wordlike": ("Berg", "Lund", "Dahl", "Stark", "Frisk"),
    "stop": ("Herr", "Fru", "Advokat", "Den", "Det", "Han", "Hon", "Och", "Domaren", "Rådman"),
    "locality": ("Stockholm", "Uppsala", "Malmö", "Upplands Väsby", "Väsby", "Örebro", "Gävle"),
    "locality_wordlike": ("Lund", "Bro", "Vara"),
}


def _strip_direction(value: Column) -> Column:
    return F.get(F.split(F.regexp_replace(value, f"^(?:{_DIRECTION})+", ""), SPACE), 0)


def pattern_spans(text: Column, which: Sequence[str] = ORDER) -> Column:
    """The spans of the detectors that are patterns, pooled in their order."""
    found = []
    plain = {"email": (EMAIL, None), "pin": (PIN, lambda v: checks.normalize_pin(v).isNotNull()), "org": (ORG, checks.is_org_number), "postal": (POSTAL, None), "phone": (PHONE, lambda v: checks.normalize_phone(v).isNotNull())}
    # A cheap look first: most texts lack what a pattern can't do without.
    needs = {"email": F.contains(text, F.lit("@")), "pin": F.rlike(text, F.lit("[0-9]{6}")), "org": F.rlike(text, F.lit("[0-9]{6}")), "postal": F.rlike(text, F.lit("[0-9]{3}")), "phone": F.rlike(text, F.lit("0[^0-9]{0,4}[0-9]|[+]46"))}
    for seq, name in enumerate(ORDER):
        if name in which and name in plain:
            pattern, accept = plain[name]
            found.append(F.when(needs[name], find_spans(text, pattern, name, name, PRIORITY[name], 100 + seq, accept)).otherwise(no_spans()))
        if name in which and name == "street":
            found += [find_spans(text, p, name, name, PRIORITY[name], 100 + seq, lambda v: ~_strip_direction(v).isin(*NOT_STREETS)) for p in STREETS]
    return pool(*found)


def city_spans(text: Column, safe: Sequence[str], wordlike: Sequence[str] = ()) -> Column:
    """Places, longest name first, with a genitive s outside.

    Those that are words too count only after a small letter, digit, comma or semicolon and a blank. The
    lists become part of a pattern: meant for a few hundred places. place_spans takes a table.
    """
    found = []
    if safe:
        found.append(find_spans(text, f"{NOT_AFTER_WORD}(?:{alternation(safe)}){NOT_BEFORE_WORD_GENITIVE}", "city", "city", PRIORITY["city"], 106))
    if wordlike:
        found.append(find_spans(text, rf"(?<=[\p{{Ll}}\p{{N}},;]{SPACE}{{1,2}})(?:{alternation(wordlike)}){NOT_BEFORE_WORD_GENITIVE}", "city", "city", PRIORITY["city"], 106))
    return pool(*found)


def _weak(text: str, at: int) -> bool:
    """Whether a small letter, digit, comma or semicolon and one or two blanks stand before a place."""
    from unicodedata import category

    blank = lambda c: c in " \t\n\x0b\x0c\r\ufeff" or category(c)[0] == "Z"
    carries = lambda c: c in ",;" or category(c) == "Ll" or category(c)[0] == "N"
    return at > 1 and blank(text[at - 1]) and (carries(text[at - 2]) or at > 2 and blank(text[at - 2]) and carries(text[at - 3]))


def _leftmost(text: str, places: list[tuple[int, int]], values: Sequence[str], classes: Sequence[str]) -> list[tuple[int, int]]:
    """Of each class the places from left to right that don't overlap, the longest at a start."""
    out, upto = [], {}
    for at, k in sorted(places, key=lambda p: (p[0], -len(values[p[1]]))):
        if at >= upto.get(classes[k], 0) and (classes[k] == "locality" or _weak(text, at)):
            upto[classes[k]] = at + len(values[k])
            out.append((at, k))
    return out


def place_spans(docs: DataFrame, dictionary: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs(text) as their key and spans of places from dictionary(term, class), as city_spans finds them, however many there are.

    class: locality, or locality_wordlike for those that are words too; others are left aside. A text's words are looked up, not every place
    of it compared with every term.
    """
    terms = dictionary.filter(F.col("class").isin("locality", "locality_wordlike")).select(F.col("term").alias("value"), "class").distinct()
    found = find_literals(docs, terms, key=key, suffixes=("s",), underscore=False, choose=_leftmost, of="class")
    city = F.lit("city")
    return found.select(*key, "start", "end", "value", city.alias("kind"), city.alias("source"), F.lit(PRIORITY["city"]).alias("priority"), F.lit(106).alias("seq"))


def has_surname_ending(token: Column) -> Column:
    """Five letters or more, one capital and then small ones, two of them before the ending."""
    endings = "|".join(SURNAME_ENDINGS)
    return F.rlike(token, F.lit(SURNAME_PATTERN)) & F.rlike(F.lower(token), F.lit(rf"^.{{2,}}(?:{endings})\z"))


def sentence_initial(text: Column, start: Column) -> Column:
    """Whether what starts there is the first of its sentence, line or label."""
    return _opens(F.substr(text, F.lit(1), start.cast("int")), F.lit(True))


def _opens(before: Column, first: Column) -> Column:
    """before: the text in front, from the start of the whole text if first, else since something that ends in a letter."""
    before = F.rtrim(before, F.lit(" \t"))
    return F.when(before == "", first).otherwise(F.rlike(F.right(before, F.lit(1)), F.lit("[.!?:;\\n\\r\"'“”‘’(\\[\\-–—•*]")))


def seed_dictionary(spark) -> DataFrame:
    return spark.createDataFrame([(t, c) for c, terms in SEED.items() for t in terms], "term string, class string")


def _strengths(dictionary: DataFrame) -> DataFrame:
    has = lambda c: F.max(F.when(F.col("class") == c, 1).otherwise(0)) == 1
    return dictionary.groupBy("term").agg(*[has(c).alias(c) for c in ("given", "given_wordlike", "surname", "surname_wordlike", "stop")])


def name_spans(docs: DataFrame, dictionary: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs(text) as their key and spans of names.

    dictionary(term, class): given, given_wordlike, surname, surname_wordlike and stop. A given name takes
    the capitalised words after it; a surname takes the one before it. Words of everyday language are
    trusted in the middle of a sentence or next to another part of a name. A genitive s stays outside.
    """
    runs = docs.filter(F.rlike("text", F.lit(CAPITAL_RUN))).select(*key, F.posexplode(matches(F.col("text"), CAPITAL_RUN)).alias("_n", "_m"))
    # "Initial" can only differ for the first word of a run: the others follow a word.
    runs = runs.select(*key, F.col("_m.start").alias("_at"), F.col("_m.value").alias("_run"), _opens(F.col("_m.before"), F.col("_n") == 0).alias("_initial"))
    words = runs.select(*key, "_at", "_run", "_initial", F.posexplode(F.split("_run", "[ \t]")).alias("_i", "_word"))
    known = _strengths(dictionary)
    cut = F.when(F.col("_word").endswith("s"), F.expr("substr(_word, 1, length(_word) - 1)"))
    direct = known.select(F.col("term").alias("_word"), F.struct("given", "given_wordlike", "surname", "surname_wordlike", "stop").alias("_d"))
    short = known.select(F.col("term").alias("_cut"), F.struct("given", "given_wordlike", "surname", "surname_wordlike", "stop").alias("_s"))
    words = words.withColumn("_cut", cut).join(direct, "_word", "left").join(short, "_cut", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    given = lambda d: F.when(yes(f"{d}.given"), 2).when(yes(f"{d}.given_wordlike"), 1).otherwise(0)
    sur = lambda d, w: F.when(yes(f"{d}.stop"), 0).when(yes(f"{d}.surname") | F.coalesce(has_surname_ending(w), F.lit(False)), 2).when(yes(f"{d}.surname_wordlike"), 1).otherwise(0)
    pick = lambda a, b: F.when(a > 0, a).otherwise(b)
    words = words.withColumns({"_g0": given("_d"), "_g1": given("_s"), "_u0": sur("_d", F.col("_word")), "_u1": F.when(F.col("_cut").isNull(), 0).otherwise(sur("_s", F.col("_cut")))})
    n = F.length("_word")
    token = F.struct(
        F.col("_i").alias("i"),
        n.alias("n"),
        pick(F.col("_g0"), F.col("_g1")).alias("given"),
        F.when((F.col("_g0") == 0) & (F.col("_g1") > 0), n - 1).otherwise(n).alias("given_n"),
        pick(F.col("_u0"), F.col("_u1")).alias("sur"),
        F.when((F.col("_u0") == 0) & (F.col("_u1") > 0), n - 1).otherwise(n).alias("sur_n"),
        (~yes("_d.stop")).alias("goes_on"),
    )
    grouped = words.groupBy(*key, "_at", "_run", "_initial").agg(F.sort_array(F.collect_list(token)).alias("_t"))
    grouped = grouped.select("*", F.inline(F.array(F.struct(_walk().alias("_found")))))
    value = lambda r: F.substr("_run", (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int"))
    spans = F.transform(
        F.filter("_found", lambda r: r["b"] - r["a"] >= 2),
        lambda r: F.struct(
            (F.col("_at") + r["a"]).alias("start"), (F.col("_at") + r["b"]).alias("end"), value(r).alias("value"), F.lit("name").alias("kind"),
            F.lit("name").alias("source"), F.lit(PRIORITY["name"]).alias("priority"), F.lit(107).alias("seq"),
        ).cast(SPAN),
    )
    return grouped.select(*key, F.inline(spans))


def _walk() -> Column:
    """The ranges of names in a run of at most four words _t, as offsets in the run."""
    t = lambda k: F.get("_t", k)
    # The words of a run stand one blank apart.
    at = lambda k: F.aggregate(F.slice("_t", F.lit(1), k), F.lit(0), lambda a, x: a + x["n"] + 1)
    ranges = "array<struct<a:int,b:int>>"
    start = F.struct(F.lit(0).alias("skip"), F.array().cast(ranges).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        i = x["i"]
        # Extend a given name over the words after it.
        reach = F.struct((x["given_n"] == x["n"]).alias("open"), i.alias("j"), (at(i) + x["given_n"]).alias("end"), F.lit(False).alias("sur"))
        steps = [reach]
        for k in (1, 2, 3):
            last = steps[-1]
            y = t(i + k)
            go = last["open"] & y.isNotNull() & F.coalesce(y["goes_on"], F.lit(False))
            further = F.struct(
                ((y["sur"] == 0) | (y["sur_n"] == y["n"])).alias("open"), (i + k).alias("j"),
                (at(i + k) + F.when(y["sur"] > 0, y["sur_n"]).otherwise(y["n"])).alias("end"), (last["sur"] | (y["sur"] > 0)).alias("sur"),
            )
            closed = F.struct(F.lit(False).alias("open"), last["j"].alias("j"), last["end"].alias("end"), last["sur"].alias("sur"))
            steps.append(F.when(go, further).otherwise(closed))
        end = steps[-1]
        middle = (i > 0) | ~F.col("_initial")
        as_given = (x["given"] == 2) | end["sur"] | (end["j"] > i) | middle
        named = F.array(F.struct(at(i).alias("a"), end["end"].alias("b"))).cast(ranges)
        after_given = F.struct((end["j"] + 1).alias("skip"), F.when(as_given, F.concat(acc["out"], named)).otherwise(acc["out"]).alias("out"))
        before = t(i - 1)
        has_given = before.isNotNull() & F.coalesce(before["goes_on"], F.lit(False))
        as_sur = (x["sur"] == 2) | has_given | middle
        pair = F.array(F.struct(F.when(has_given, at(i - 1)).otherwise(at(i)).alias("a"), (at(i) + x["sur_n"]).alias("b"))).cast(ranges)
        after_sur = F.struct((i + 1).alias("skip"), F.when(as_sur, F.concat(acc["out"], pair)).otherwise(acc["out"]).alias("out"))
        return F.when(i < acc["skip"], acc).when(x["given"] > 0, after_given).when(x["sur"] > 0, after_sur).otherwise(acc)

    return F.aggregate("_t", start, step, lambda acc: acc["out"])
