"""HTML extraction: equivalence classes of tokens make a host's template, and its main slot is read.

Tokens are a page's block elements, each named by its chain of tags, ids and classes (or, without these,
by its place among its like), and its text blocks, each named by its element and its text. A token's occurrence vector says how often it comes on each page of
the host. Tokens with one vector are an equivalence class. A class is valid if its tokens come once a page,
and it is frequent (on half of the host's pages), or large (three tokens or more) and on three pages and a
twentieth of them: so the layouts that some of the pages share, and optional parts, have classes of their own.
Chains of elements nest the valid classes into the host's template.

A page holds those classes whose tokens it has, in the template's order; a token out of order is left aside
on that page. What an element of the template holds outside of its template children is a slot. The main slot is found from
the root down: at each element the one child that is the page's article, or holds most of the text, until
the text is spread over several. It is read with the slots nested in it.

Inside an article or main element everything is read, on however many pages it stands, but for elements that their tag or role
sets apart (as nav, aside, form), such that are named as adverts or reader comments and nothing else, and lists or
boxes named as menus that hold links only. Elsewhere words in ids and classes set an element apart, unless it
holds most of the page's text. Where the main slot has no article, an element of the template whose text is a
class itself (the same words on all pages that have it) is furniture, and so are its lists of links.

A page is parsed twice, and goes to its host's template in a join on host and chunk: large hosts are cut
into chunks of CHUNK_PAGES pages, and each chunk gets a copy of the template. The template of a host has
at most as many tokens as some twenty of its pages.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiflow.llm.common import spread, written

CHUNK_PAGES = 1_000
#: Hosts with more than one in this many of all pages are large; so there are fewer large hosts than this.
LARGE_HOSTS = 100_000

#: Comments, raw elements, tags and what lies between; all but text may be cut off by the end.
_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|noscript|template|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: Elements that end an open paragraph before them.
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY_NEXT = frozenset("p li tr td th option dt dd".split())
_OTHER_TAGS = frozenset("head nav footer aside form button select dialog".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
_OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal "
    "nav navbar navigation newsletter notice notices pagination popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: Words beside these that say no more: ad-slot and comment-list are marked, share-prices is not.
_BESIDE = frozenset(
    "area bar block body bottom box btn button buttons container content form group header holder inner item items left links list main message panel posts primary right row secondary section site "
    "slot text title top unit wrap wrapper".split()
)
#: Inside an article these set an element apart; other words do only where it holds nothing but links.
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising promo promoted sponsor sponsored".split())
_COMMENTS = frozenset("comment comments disqus respond".split())
#: These mark what has articles of its own, however long it is.
_APART = frozenset("comment comments disqus related respond".split())
#: Ids and classes of these only name them: they are parts of a text, as <h2 id="login-flow">.
_NAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
_ARTICLES = ("article", "main")
_HEADER_WORDS = frozenset("header masthead topbar".split())
#: Through these the main slot is looked for.
_HOLDERS = frozenset("html body div section main article table tbody tr td center".split())
_WORDS = re.compile(r"[a-z]+")
#: Long numbers and hex in ids and classes differ by page, as in post-123; short ones tell columns apart, as col-8 and col-4.
_NUMBERS = re.compile(r"(?<![a-z0-9])(?=[a-f]*[0-9])[0-9a-f]{6,}(?![a-z0-9])|[0-9]{3,}")
_DIGITS = re.compile(r"(?<![a-z0-9])(?=[a-f]*[0-9])[0-9a-f]{6,}(?![a-z0-9])|[0-9]+")


def _marks(name: str, words: frozenset) -> set[str]:
    """The words of an id or class that mark other text, if it says nothing else."""
    found = set(_WORDS.findall(name))
    return found & words if found and found <= words | _BESIDE else set()


class Page:
    """A parsed page: its elements as a tree of numbers, in page order, and its text blocks.

    Element 0 is the page itself. token is the hash of an element's chain of names; set_apart says why an
    element is not main text by itself: "" (it is), "tag", "name", or "menu" (if it holds links only). blocks are (element, text, characters
    in links); inline elements are part of a block. All work grows with the page's length, however deep it is.
    """

    def __init__(self, html: str):
        import xxhash

        self.parent, self.tag, self.token, self.set_apart = [0], [""], [0], [""]
        self.blocks: list[tuple[int, str, int]] = []
        wrapper: list[bool] = [False]  # may hold the page's text in spite of its mark
        inside_of: list[int] = [0]  # the article around an element
        stack, open_, buffer = [0], {}, []
        nameless: dict[tuple[int, str], int] = {}  # how many of an element's children have no name but their tag
        link, linked, at = False, 0, 0

        def flush() -> None:
            nonlocal linked
            if text := " ".join("".join(buffer).split()):
                self.blocks.append((stack[-1], text, min(linked, len(text))))
            buffer.clear()
            linked = 0

        def pop() -> None:
            open_[self.tag[stack.pop()]] -= 1

        for m in _TOKENS.finditer(html):
            if m.start() > at:
                buffer.append(entities.unescape(html[at : m.start()]))
                if link:
                    linked += len(buffer[-1])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in ("br", "hr"):
                buffer.append(" ")
                continue
            if tag in _VOID:
                continue
            if tag == "a":
                link = not m["close"]
            if m["close"]:
                if tag in _INLINE and not open_.get(tag):
                    continue
                flush()
                if open_.get(tag):
                    while self.tag[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            found = [(n.lower(), (a or b or c).lower()) for n, a, b, c in _ATTRIBUTE.findall(m["attrs"])] if m["attrs"] else []
            names = [x for n, v in found if n != "role" for x in v.split()]
            article = inside_of[stack[-1]]
            by_tag = tag in _OTHER_TAGS or any(n == "role" and v in _OTHER_ROLES for n, v in found)
            by_tag = by_tag or not article and (tag == "header" or any(_marks(x, _HEADER_WORDS) for x in names))
            words = set() if tag in _NAMED else set().union(*(_marks(x, _OTHER_WORDS) for x in names)) if names else set()
            if tag in _NAMED:
                by_tag = False
            if tag in _INLINE and not words and not by_tag:
                continue
            flush()
            top = self.tag[stack[-1]]
            if tag in _BLOCKS and top == "p" or tag == top and tag in _CLOSED_BY_NEXT:
                pop()
            numbers = _DIGITS if tag in ("html", "body", *_ARTICLES) else _NUMBERS
            name = tag + "".join(f".{x}" for x in sorted(numbers.sub("#", " ".join([*names, *(f"role={v}" for n, v in found if n == "role")])).split()))
            above = stack[-1]
            if name == tag and tag in _HOLDERS:
                # Their place tells them apart, as far as a layout goes.
                nth = nameless[above, tag] = nameless.get((above, tag), 0) + 1
                name = f"{tag}:{min(nth, 9)}"
            self.parent.append(above)
            self.tag.append(tag)
            self.token.append((xxhash.xxh64_intdigest(f"{self.token[above]}/{name}") + (1 << 63)) % (1 << 64) - (1 << 63))
            named = "menu" if article and not words & (_ADVERTS | _COMMENTS) else "name"
            self.set_apart.append("tag" if by_tag else named if words else "")
            wrapper.append((tag == "form" or not by_tag) and not (words & _APART and not article))
            inside_of.append(len(self.parent) - 1 if tag in _ARTICLES else article)
            stack.append(len(self.parent) - 1)
            open_[tag] = open_.get(tag, 0) + 1
        if at < len(html):
            buffer.append(entities.unescape(html[at:]))
        flush()
        self.in_article = [of > 0 for of in inside_of]
        self._menus()
        self._lift(wrapper, inside_of)

    def sums(self, values: list[int]) -> list[int]:
        """Of each element the sum over itself and all in it."""
        for k in range(len(values) - 1, 0, -1):
            values[self.parent[k]] += values[k]
        return values

    def _menus(self) -> None:
        """Takes back marks of menus from elements that hold more than links."""
        chars, links = [0] * len(self.parent), [0] * len(self.parent)
        for node, text, linked in self.blocks:
            chars[node] += len(text)
            links[node] += linked
        chars, links = self.sums(chars), self.sums(links)
        for k, mark in enumerate(self.set_apart):
            if mark == "menu":
                self.set_apart[k] = "name" if 10 * links[k] >= 9 * chars[k] else ""

    def _lift(self, wrapper: list[bool], inside_of: list[int]) -> None:
        """Takes back marks of elements that hold most of the text of their page or article: they are around it."""
        chars = [0] * len(self.parent)
        own_article = False
        for node, text, _ in self.blocks:
            chars[node] += len(text)
        fixed = [False] * len(chars)  # set apart for good, itself or by what it is in
        marked = [False] * len(chars)
        for k in range(1, len(chars)):
            fixed[k] = fixed[self.parent[k]] or self.set_apart[k] != "" and not wrapper[k]
            marked[k] = marked[self.parent[k]] or self.set_apart[k] != ""
            if fixed[k]:
                chars[k] = 0
        for node, text, _ in self.blocks:
            own_article = own_article or inside_of[node] > 0 and not marked[node]
        chars = self.sums(chars)
        for k in range(1, len(chars)):
            if self.set_apart[k] and wrapper[k]:
                around = inside_of[k] if inside_of[k] != k else 0
                if 2 * chars[k] > chars[around] and (around or not own_article):
                    self.set_apart[k] = ""

    def other(self) -> list[bool]:
        """Of each element whether it is set apart, itself or by what it is in."""
        out = [False] * len(self.parent)
        for k in range(1, len(out)):
            out[k] = out[self.parent[k]] or self.set_apart[k] != ""
        return out


def _text_token(element: int, text: str) -> int:
    import xxhash

    return (xxhash.xxh64_intdigest(f"{element}#{text}") + (1 << 63)) % (1 << 64) - (1 << 63)


_TOKEN = "token long, parent long, tag string, n long, chars long, links long, pos long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's tokens: how often they come, the main text in them and how much of it are links, and their place."""
    names = ["host", "page", *(c.split()[0] for c in _TOKEN.split(", "))]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4)

    def table(out: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((*k[:2], k[2], *v) for k, v in out.items())), kinds)], names)

    for batch in batches:
        out: dict[tuple, list] = {}
        for row, (host, number, text) in enumerate(zip(batch["host"].to_pylist(), batch["page"].to_pylist(), batch["html"])):
            page = Page(text.as_py() or "")
            other = page.other()
            chars, links = [0] * len(other), [0] * len(other)
            for node, block, linked in page.blocks:
                if not other[node]:
                    chars[node] += len(block)
                    links[node] += linked
            chars, links = page.sums(chars), page.sums(links)
            seen: dict[int, list] = {}
            for k in range(1, len(other)):
                own = seen.setdefault(page.token[k], [page.token[page.parent[k]], page.tag[k], 0, 0, 0, k])
                own[2] += 1
                own[3] += chars[k]
                own[4] += links[k]
            for k, (node, block, linked) in enumerate(page.blocks):
                if not other[node] and not page.in_article[node]:
                    own = seen.setdefault(_text_token(page.token[node], block), [page.token[node], "#", 0, 0, 0, node])
                    own[2] += 1
                    own[3] += len(block)
                    own[4] += linked
            out |= {(host, number, token, row): v for token, v in seen.items()}
            if len(out) > 50_000:
                yield table(out)
                out = {}
        if out:
            yield table(out)


def _sizes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts with their pages, and the large ones among them with their number of chunks."""
    sizes = written(pages.groupBy("host").agg(F.count("*").alias("pages")))
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    large = sizes.filter(F.col("pages") > max(CHUNK_PAGES, total / LARGE_HOSTS))
    return sizes, large.select("host", F.ceil(F.col("pages") / CHUNK_PAGES).cast("int").alias("chunks"))


def _joined(many: DataFrame, one: DataFrame, large: DataFrame, by: str, how: str) -> DataFrame:
    """many joined with the row of one for its host, where rows of large hosts are dealt to chunks by a column."""
    large = F.broadcast(large)  # fewer than LARGE_HOSTS rows
    chunks = F.coalesce("chunks", F.lit(1))
    many = many.join(large, "host", "left").withColumn("_chunk", F.pmod(F.xxhash64(by), chunks).cast("int")).drop("chunks")
    # Written, so that Spark knows how small it is, and moves many only where it must.
    one = written(one.join(large, "host", "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks"))
    return many.join(one, ["host", "_chunk"], how).drop("_chunk")


def templates(pages: DataFrame, support: float = 0.5, part: float = 0.05, part_pages: int = 3, part_tokens: int = 3, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """pages(host, page, html) as host, pages and its template's classes.

    A class is on support of the host's pages, or on part of them (part_pages at least) and has part_tokens or
    more. Text outside of articles is part of a class that has elements and is on part_pages pages at least.
    """
    of_host, large = _sizes(pages) if sizes is None else sizes
    tokens = pages.mapInArrow(_tokens, "host string, page long, " + _TOKEN)
    seen = F.xxhash64("page", "n")
    by_token = tokens.groupBy("host", "token").agg(
        # Sums of both halves of a hash: vectors are told apart, and repeated pages count anew.
        F.sum(seen.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v1"), F.sum(F.shiftrightunsigned(seen, 32)).alias("v2"), F.count("*").alias("on"), F.max("n").alias("most"),
        F.min("parent").alias("parent"), F.min("tag").alias("tag"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("pos").alias("pos"),
    )
    known = _joined(by_token, of_host, large, "token", "inner")
    frequent = F.col("on") >= support * F.col("pages")
    partly = (F.col("on") >= part * F.col("pages")) & (F.col("on") >= part_pages)
    once = (F.col("most") == 1) & ((F.col("tag") != "#") | (F.col("on") >= part_pages))
    known = known.filter((frequent | partly) & once)
    token = F.struct("token", "parent", "tag", "chars", "links", (F.col("pos") / F.col("on")).alias("pos"), (F.col("on") >= part_pages).alias("recurs"))
    classes = known.groupBy("host", "v1", "v2", "on", "most").agg(
        F.collect_list(token).alias("tokens"), F.max(F.col("tag") != "#").alias("elements"), F.max(frequent).alias("frequent"), F.max("pages").alias("pages"),
    )
    valid = (F.col("most") == 1) & F.col("elements") & (F.col("frequent") | (F.size("tokens") >= part_tokens))
    return classes.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(F.when(valid, F.col("tokens"))).alias("classes"))


def in_order(places: list[int]) -> list[int]:
    """Which of the places make the longest rising sequence."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(places)
    for k, x in enumerate(places):
        j = bisect_left(ends, x)
        before[k] = last[j - 1] if j else -1
        ends[j : j + 1] = [x]
        last[j : j + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def main_element(children: dict[int, list[int]], tags: dict[int, str], chars: dict[int, int]) -> int:
    """From the root of a template (0) down to the element of the main slot."""
    at = 0
    while True:
        below = children.get(at, [])
        marked = [x for x in below if tags[x] in _ARTICLES and chars[x]]
        if len(marked) == 1:
            at = marked[0]
            continue
        total = chars[at] if at else sum(chars[x] for x in below)
        most = max(below, key=lambda x: (chars[x], x), default=None)
        if tags.get(at) == "article" or most is None or 2 * chars[most] <= total or tags[most] not in _HOLDERS:
            return at
        at = most


def _tree(tokens: list[tuple[int, int, str, int]]) -> tuple[dict, dict, dict]:
    children, tags, chars = {}, {}, {}
    for token, parent, tag, n in tokens:
        children.setdefault(parent, []).append(token)
        tags[token], chars[token] = tag, n
    return children, tags, chars


class Template:
    """The valid classes of a host, matched to a page at a time."""

    def __init__(self, classes: list):
        self.classes = [sorted(c, key=lambda t: (t["pos"], t["tag"] == "#", t["token"])) for c in classes]

    def read(self, page: Page) -> str:
        other = page.other()
        place: dict[int, int] = {}
        for k in range(1, len(page.parent)):
            place.setdefault(page.token[k], k)
        texts = {}
        for node, block, _ in page.blocks:
            texts.setdefault(_text_token(page.token[node], block), node)
        held, fixed = [], set()
        for c in self.classes:
            elements = [t for t in c if t["tag"] != "#"]
            if not all(t["token"] in place for t in elements):
                continue
            ordered = in_order([place[t["token"]] for t in elements])
            held += [elements[k] for k in ordered]
            # Furniture has an element of its own in the template.
            of_class = {elements[k]["token"] for k in ordered}
            fixed |= {t["token"] for t in c if t["tag"] == "#" and t["token"] in texts and t["parent"] in of_class}
        children, tags, chars = _tree([(t["token"], t["parent"], t["tag"], t["chars"]) for t in held])
        main = main_element(children, tags, chars)
        inside = self._inside(page, main)
        if main and not any(inside[node] and not other[node] for node, _, _ in page.blocks):
            # A page of another kind is a template of its own.
            held, inside = [], self._inside(page, self._own_main(page, other))
        # Pages that are copies of each other have nothing but common text.
        own = [(node, b) for node, b, _ in page.blocks if inside[node] and not other[node]]
        furniture = lambda node, b: not page.in_article[node] and _text_token(page.token[node], b) in fixed
        common = sum(len(b) for node, b in own if furniture(node, b))
        if 5 * common >= sum(len(b) for _, b in own):
            fixed = set()
        article = self._own_article(page, own, inside)
        # Lists among the nested slots that recur and hold links only are menus, but for an article's own.
        menus = {t["token"] for t in held if t["tag"] in ("ul", "ol") and t["token"] != main and t["recurs"] and 10 * t["links"] >= 9 * t["chars"] > 0}
        apart = [False] * len(inside)
        for k in range(1, len(inside)):
            apart[k] = apart[page.parent[k]] or page.token[k] in menus and not page.in_article[k]
        return " ".join(b for node, b in own if article[node] and not apart[node] and not furniture(node, b))

    def _inside(self, page: Page, main: int) -> list[bool]:
        out = [main == 0] * len(page.parent)
        for k in range(1, len(out)):
            out[k] = out[page.parent[k]] or page.token[k] == main
        return out

    def _own_main(self, page: Page, other: list[bool]) -> int:
        chars = [0] * len(other)
        for node, block, _ in page.blocks:
            chars[node] += len(block) * (not other[node])
        chars = page.sums(chars)
        seen: dict[int, list] = {}
        for k in range(1, len(other)):
            own = seen.setdefault(page.token[k], [page.token[page.parent[k]], page.tag[k], 0])
            own[2] += chars[k]
        return main_element(*_tree([(t, *v) for t, v in seen.items()]))

    def _own_article(self, page: Page, own: list[tuple[int, str]], inside: list[bool]) -> list[bool]:
        """What lies in a page's one article or main below the main slot, if that holds most of the slot's text; else all."""
        of = [0] * len(inside)
        for k in range(1, len(of)):
            above = of[page.parent[k]]
            of[k] = above or (k if inside[k] and inside[page.parent[k]] and page.tag[k] in _ARTICLES else 0)
        found = {of[node] for node, _ in own} - {0}
        if len(found) == 1 and 2 * sum(len(b) for node, b in own if of[node]) > sum(len(b) for _, b in own):
            return [x > 0 for x in of]
        return [True] * len(of)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        texts = []
        for host, classes, text in zip(batch["host"].to_pylist(), batch["classes"], batch["html"]):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = Template(classes.as_py() or [])
            texts.append(known[host].read(Page(text.as_py() or "")))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as page_id, url and the main text.

    Character references are decoded, white space in a block becomes one blank, and blocks are joined by
    one blank in page order. A null or empty html gives an empty text. Pages without a readable host in
    their url share one host. Repeated rows are pages of their own; other columns are left out. An empty
    table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    sizes = _sizes(pages)
    found = templates(pages.select("host", "page", "html"), sizes=sizes)
    joined = _joined(pages, found, sizes[1], "page", "left")
    return joined.select("page_id", "url", "host", "classes", "html").mapInArrow(_extracted, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the main text of every page."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
