"""What stands inside an article is read, on however many pages of the host it stands."""

import random

import pytest

from piiflow.llm import html_extract


def prose(k, n=12):
    rng = random.Random(k)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def page(body):
    return f'<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy this now</div>{body}<footer>Our address</footer></body></html>'


def read(spark, bodies):
    rows = [(k, f"https://host.example/{k}", page(b)) for k, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[k] for k in range(len(bodies))]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 40])
def test_sentences_and_lists_that_articles_share(spark, n):
    shared = "<p>All prices are in euro.</p>"
    some = lambda k: "<p>The trial was run in three centres.</p>" if k % 5 < 3 else ""
    links = '<ul><li><a href="/1">First source</a><li><a href="/2">Second source</a></ul>'
    bodies = [f"<article><h1>Title {k}</h1><p>{prose(k)}</p>{shared}{some(k)}{links}</article>" for k in range(n)]
    want = [f"Title {k} {prose(k)} All prices are in euro.{' The trial was run in three centres.' if some(k) else ''} First source Second source" for k in range(n)]
    assert read(spark, bodies) == want


@pytest.mark.parametrize("n", [1, 2, 6])
def test_names_of_parts_of_an_article(spark, n):
    names = ["search", "share", "login", "widget", "banner-text", "notice-text", "menu-items", "related", "social"]
    inner = lambda k: "".join(f'<div class="{x}">{prose(100 * k + j)}</div>' for j, x in enumerate(names))
    apart = '<div class="ad-slot">Buy</div><div id="comments"><p>Great!</p></div><aside>Also</aside><form>Mail</form><div class="share"><a href="/t">Tell others</a></div>'
    bodies = [f"<article><p>{prose(k)}</p>{inner(k)}{apart}</article>" for k in range(n)]
    assert read(spark, bodies) == [" ".join([prose(k), *(prose(100 * k + j) for j in range(len(names)))]) for k in range(n)]


@pytest.mark.parametrize("n", [3, 8])
def test_furniture_without_an_article(spark, n):
    """Of a page of plain boxes, a box with the same words on all pages is furniture; a sentence in a box of its own text is not."""
    bodies = [f"<div><div>Reader since 1990</div><div>{prose(k, 60)}<p>All prices are in euro.</p><p>{prose(k + 50)}</p></div></div>" for k in range(n)]
    assert read(spark, bodies) == [f"{prose(k, 60)} All prices are in euro. {prose(k + 50)}" for k in range(n)]
