"""Main text of pages with open elements, forms around the page, comments and malformed tags."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import html

TEXT = "One two three four five six seven. Eight nine ten eleven twelve."


def text_of(page, weights=html.DEFAULT_WEIGHTS):
    return html.main_text(page, weights)


@pytest.mark.parametrize(("page", "want"), [
    ('<body><p class="notice">Ad<p>%s</body>', TEXT), ('<ul><li class="share">Tell it<li>%s</ul>', TEXT), ('<p class="ad">Buy<div>%s</div>', TEXT),
    ('<table><tr><td class="menu">A<td>%s</table>', TEXT), ('<dl><dt class="nav">A<dd>%s</dl>', TEXT), ("<nav><a href=/>Home</a><article>%s</article>", TEXT),
    ('<div class="cookie-bar">We use them<main>%s</main>', TEXT), ("<head><title>No</title><body>%s", TEXT), ("<head><meta charset=x><p>%s", TEXT),
    ("<div><canvas>fallback</div><p>%s</p>", TEXT),
])
def test_implied_ends(page, want):
    assert text_of(page % TEXT) == want


@pytest.mark.parametrize("inside", ["<article>%s</article>", "<h1>%s</h1>", "<nav><a>x</a></nav><div>%s</div><footer>f</footer>", "<div><p>%s</p><p>" + " ".join(["more"] * 30) + "</p></div>"])
def test_a_form_around_the_page_is_no_form(inside):
    got = text_of(f"<form id=aspnetForm action=x><input type=hidden value=y>{inside % TEXT}</form>")
    assert TEXT in got and " x " not in f" {got} "
    assert text_of(f"<p>{TEXT}</p><form><p>Write to us</p><input><label>Name</label></form>") == TEXT


def test_reader_comments_are_left_out():
    comments = '<section class="comments"><article class="comment"><p>What a fine text this is, I say!</p></article><article><p>And so say I, at length.</p></article></section>'
    for page in (f"<article><p>{TEXT}</p></article>{comments}", f"<article><p>{TEXT}</p>{comments}</article>", f"<main><p>{TEXT}</p>{comments}</main>"):
        assert text_of(page) == TEXT
    assert text_of(f'<article>{TEXT}</article><aside><article class=card>Another story</article></aside>') == TEXT
    assert text_of(f'<article>{TEXT}</article><article class="comment">Well said, and more</article>') == TEXT


NAMED = ["share price", "social policy", "content related", "search-results", "widget", "modal", "ad", "notice board", "promo popup", "comment-worthy"]


@pytest.mark.parametrize("name", NAMED)
@pytest.mark.parametrize("page", [
    '<body><article class="{}"><p>%s</p></article><p>by the way</p></body>', '<body><main><div class="{}"><p>%s</p></div></main></body>', '<body><div id="{}"><article><p>%s</p></article></div><div>foot note</div></body>',
    '<body><nav>a b c</nav><div class="{}"><div><p>%s</p></div></div></body>', '<body><div class="{}"><main><h1></h1><p>%s</p></main></div></body>',
])
def test_names_alone_take_no_article_away(page, name):
    pages = [f"<body><div class=ad>buy this now {n}</div><article><p>{TEXT} {n}</p></article></body>" for n in range(40)]
    for weights in (html.DEFAULT_WEIGHTS, html.learn(pages)):
        assert TEXT in text_of(page.format(name) % TEXT, weights)


def test_names_still_mark_what_is_beside_the_article():
    for name in NAMED:
        page = f'<body><article><p>{TEXT}</p><div class="{name}">Look at this</div></article><div class="{name}"><p>Three words more</p></div></body>'
        assert text_of(page) == TEXT
    comments = "<div class=comments>" + "<p>I have a lot to say about that, more than the story has.</p>" * 20 + "</div>"
    assert text_of(f"<body><article><p>{TEXT}</p></article>{comments}</body>") == TEXT
    assert text_of(f"<body><article><p>{TEXT}</p>{comments}</article></body>") == TEXT


@pytest.mark.parametrize("depth", [100, 300, 5000])
def test_deep_nesting(depth):
    assert text_of(f"<nav><div>{'<b>' * depth}</nav><p>{TEXT}</p>") == TEXT
    assert text_of(f"{'<div>' * depth}<p>{TEXT}</p>{'</div>' * depth}<footer>x</footer>") == TEXT
    assert text_of(f"<ul><li class=menu>{'<i>' * depth}<li>{TEXT}</ul>") == TEXT


def test_lists_and_links_do_not_cut_a_marked_article():
    links = "<ul>" + "<li><a href=x>one</a></li>" * 30 + "</ul>"
    assert text_of(f"<body><article><p>An introduction.</p>{links}<p>{TEXT}</p></article></body>", html.learn([f"<body><nav>{links}</nav><article><p>{TEXT}</p></article></body>"] * 30)) == f"An introduction. {' '.join(['one'] * 30)} {TEXT}"


def test_labels_overrule_the_prior():
    pages = [f'<body><div class=top>{"junk " * 30}</div><article><div class="widget"><p>{TEXT} {n}</p></div><p>x</p></article></body>' for n in range(40)]
    weights = html.learn(pages)
    assert weights["name:widget"] > 0
    page = f'<body><div class="widget"><p>{TEXT}</p></div><div class=story><p>{TEXT * 3}</p></div></body>'
    assert text_of(page, weights).startswith(TEXT + " ") and not text_of(page).startswith(TEXT + " ")


def test_labelled_pages_teach_names():
    pages = [f'<body><div class="zz-top"><p>{"junk " * 30}</p></div><article><div class="copy"><p>{TEXT} {n}</p></div></article></body>' for n in range(40)]
    weights = html.learn(pages)
    assert weights["name:zz"] < 0 and "name:copy" not in weights
    page = f'<body><div class="zz-top"><p>{"junk " * 30}</p></div><div class="copy"><p>{TEXT}</p></div></body>'
    assert text_of(page, weights) == TEXT and "junk" in text_of(page)


@pytest.mark.parametrize("bad", ["<a ", '<a b="', "<a b='>", "<p><b>", "<p><table><td><b>", "<form>", "<!--", "<!-- x -->", '<a b=">" ', "</x>", "<li>", "<script>", "<title>", "<", "&amp;", "<div class=ad>", "<q a=b c='d' \n"])
def test_time_is_linear(bad):
    took = []
    for size in (125_000, 1_000_000):
        page = bad * (size // len(bad)) + f"<article>{TEXT}</article>"
        start = time.monotonic()
        text_of(page)
        took.append(time.monotonic() - start)
    assert took[1] < 60 * max(took[0], 0.02), took  # eight times the page; quadratic would be 64 times at least


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{TEXT}</p>"), (1, "u", f"<p>{TEXT}</p>")], "page_id long, url string, html string")
    pages = pages.withColumns({"text": F.lit("mine"), "n_chars": F.lit(0), "__html": F.lit("x"), "o": F.lit(1), "h": F.lit(2)})
    rows = html.extract(pages, html.fit(pages)).collect()
    assert [tuple(r) for r in rows] == [(1, "u", TEXT, len(TEXT))] * 2
    assert html.extract(pages, html.DEFAULT_WEIGHTS, keep=("page_id", "text")).columns == ["page_id", "text", "n_chars"]
