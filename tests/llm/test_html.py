"""Main text of the given pages, of pages of other make, and of broken ones."""

from __future__ import annotations

import html
import re
import time

import pytest

from fluxlens.llm.html_text import extract, main_text

LONG = "This sentence of the text is long enough to be taken for text by anyone who reads it."


def article_of(page: str) -> str:
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inner))
    return " ".join(b for b in blocks if b)


def test_given_pages(spark, rows_of):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: (r["url"], t := article_of(r["html"]), len(t)) for r in rows_of("pages", "/root/testdata/sf0.01")}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in extract(pages).collect()} == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><header><h1>Site</h1></header><ul class=menu><li><a href=/>Home</a></ul><div id=content><p>{LONG}</p><p>Short.</p><div class='ad-box'>Buy</div><p>{LONG}</p></div>"
         f"<div class=comments><article class=comment><p>{LONG}</p></article></div><form>Find<input></form><div class='cookie-notice'>{LONG}</div></body>", f"{LONG} Short. {LONG}"),
        (f"<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><div><p>{LONG}<p>{LONG}</div><ul><li><a href=/c>Three</a></ul>", f"{LONG} {LONG}"),
        ("<div class=ad>left open<article><header><h1>T</h1></header><p>a<p>b<aside>no</aside><p>c</article>after", "T a b c"),
        ("<main><p>one</p><section class=related><p>no</p></section><p>two</p></main>", "one two"),
        ("plain &lt;text&gt; &eacute;&#233;\n\t only", "plain <text> éé only"),
        ("<p title='a>b'>in<b>side</b> x<br>next<!-- no <p>no</p> -->", "inside x next"),
        ("<script>var a='<p>no</p>'", ""),
        ("<article><p>cut off <em>he", "cut off he"),
        ("<p>a <span class=ad>no</span> b</p>", "a b"),
        ("", ""), (None, ""), ("<<<>>>", "<<<>>>"), ("<p></p><nav>only a menu</nav>", ""),
    ],
)
def test_pages_of_other_make(page, text):
    assert main_text(page) == text


def test_large_and_broken_pages_take_linear_time():
    started = time.perf_counter()
    for page in ("<p>a " * 50_000, "<div>" * 50_000, "<" * 300_000, "<!--" * 50_000, '<a "' * 50_000, "<script>" * 50_000, "&" * 200_000):
        main_text(page)
    assert time.perf_counter() - started < 30


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>t</p>", None), (2, "u", "", "x"), (2, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, None, "t", 1), (1, "u", "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert extract(pages.limit(0)).isEmpty()


def test_linked_text_of_an_article_stays():
    references = "".join(f"<li><a href=/{i}>Reference {i}</a></li>" for i in range(5))
    names = " ".join(f"Reference {i}" for i in range(5))
    assert main_text("<article><h1><a href='/x'>Title</a></h1><p>Body</p></article>") == "Title Body"
    assert main_text(f"<nav><a href=/>Home</a></nav><article><p>Body</p><ul>{references}</ul><p>More</p></article><a href=/z>Out</a>") == f"Body {names} More"
    assert main_text(f"<main><p>Body</p><ul>{references}</ul></main><p>{LONG}</p>") == f"Body {names}"
    assert main_text("<article><p><a href=/only>Only a link</a></p></article>") == "Only a link"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>one</p><svg class="icon"/><p>two</p><svg><text>no</text></svg><p>three</p></article>', "one two three"),
        ("<article><p>one</p><svg class=i><path d='M0'><p>two</p></article>", "one two"),
        ("<article><p>a link<svg><path/></svg>. Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, and <math/> more</p></article>", "a link. Then x=2, and more"),
        ("<article><div>one<select><option>no</div><p>two</p><div><object><p>no</p></div><p>three</p></article>", "one two three"),
        ("<main><p>one</p><section><canvas>no</section><noscript>no</noscript><p>two</p></main>", "one two"),
        (f"<div><p>{LONG * 9}</p></div>" + "<p><a href=/>link</a></p>" * 3 + f"<div><p>{LONG}</p></div>", f"{LONG * 9} link link link {LONG}"),
        ("<div>" + "<p>a line of verse</p>" * 40 + "</div>", " ".join(["a line of verse"] * 40)),
        (f"<p>{LONG}</p>" + "<p>Said he.</p>" * 9, f"{LONG}" + " Said he." * 9),
    ],
)
def test_nothing_is_lost_after_open_elements_or_between_stretches(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<main><h2 id="related-work">Earlier</h2><p>Body</p><section id="side-effects"><p>Harm</p></section><h3 id="advertising">Ads</h3><p>Tail</p></main>', "Earlier Body Harm Ads Tail"),
        (f'<form id="aspnetForm"><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><input name=q></div></form>', f"Title {LONG} {LONG} {LONG}"),
        ("<aside><article>Teaser</article></aside><main>Body</main>", "Body"),
        (f'<div class="comments"><article>first comment</article></div><p>{LONG}</p><p>{LONG}</p>', f"{LONG} {LONG}"),
        (f'<div class="page-with-sidebar"><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div class="sidebar"><p>{LONG}</p></div></div>', f"T {LONG} {LONG} {LONG}"),
        (f'<h2 id="side-effects">Side effects</h2><p>{LONG}</p><div id="sidebar-left"><p>{LONG}</p></div><section id="social-life"><p>{LONG}</p></section>', f"Side effects {LONG} {LONG}"),
        (f'<article class="teaser"><p>Read more</p></article><article>Short</article><div><p>{LONG * 4}</p></div>', f"{LONG * 4}"),
        (f"<main><p>{LONG}</p><div id=comments><p>reader</p></div><div class='share-buttons'>Share</div><div class=advert>Buy</div><p>End</p></main>", f"{LONG} End"),
        (f"<main><p>{LONG}</p></main><div class=comments>" + f"<p>{LONG}</p>" * 20 + "</div>", LONG),
        (f'<form class="search-form"><p>Find</p></form><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><form id=commentform>' + "<p>x</p>" * 9 + "</form>", f"{LONG} {LONG} {LONG}"),
    ],
)
def test_names_and_tags_are_evidence_among_others(page, text):
    assert main_text(page) == text


def test_windows_decide_on_given_pages(rows_of, monkeypatch):
    """Text within the element and text around it are weighed by windows on every page: without the prior, and with the
    article's text in links and other text around it, the choice changes."""
    page = next(r["html"] for r in rows_of("pages", "/root/testdata/sf0.01"))
    want = article_of(page)
    assert main_text(page) == want
    body = "".join(f"<p>{LONG}</p>" for _ in range(len(want) // 10))
    assert main_text(page + body) == " ".join([LONG] * (len(want) // 10))
    monkeypatch.setattr("fluxlens.llm.html_text.SURGE", 10**9)
    monkeypatch.setattr("fluxlens.llm.html_text._stretch", lambda found, weights: "")
    assert main_text(page) == ""  # no page has a way around the windows
