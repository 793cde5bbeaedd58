"""Main text of pages whose scripts hold '<' and whose tags hold stray quotes."""

from __future__ import annotations

import pytest

from lodestrata.llm import html

BODY = "<article><p>One two three four five.</p><p>Six seven eight nine ten.</p></article>"
WANT = "One two three four five. Six seven eight nine ten."


@pytest.mark.parametrize("before", [
    "<script>for(i=0;i<n;i++){f()}</script>", "<script>if(a<b && c>d)g('</p>')</SCRIPT >", "<style>a<b{}</style>", "<title>a<b or c</title>",
    "<textarea>x <y z</textarea>", "<svg><style>a<b{}</style><path/></svg>", "<script>i<n</script><script>j<m</script>", "<script>'<!--'</script>",
    "<p title=\"a > b\"></p>", "<p data-x='<b>no</b>'></p>", "<script src=x.js></script>",
])
def test_text_after_raw_elements_is_kept(before):
    assert html.main_text(before + BODY, html.DEFAULT_WEIGHTS) == WANT
    assert html.main_text(f"<html><head>{before}</head><body>{BODY}<script>k<l</script></body>", html.DEFAULT_WEIGHTS) == WANT


def test_stray_quotes_do_not_swallow_text():
    for stray in ('<p class="x"">', '<p title="x>', "<p class='x''>", "<p it's>"):
        page = f"<article>{stray}One two three four five.</p><p class=\"y\">Six seven eight nine ten.</p><p class='z'></p></article>"
        assert html.main_text(page, html.DEFAULT_WEIGHTS) == WANT


def test_an_unclosed_tag_takes_little_time():
    assert html.main_text("<p " + "a=\"b\" c='d' " * 2000, html.DEFAULT_WEIGHTS)


def test_unclosed_script_ends_with_the_page():
    assert html.main_text(BODY + "<script>a<b <p>no words</p>", html.DEFAULT_WEIGHTS) == WANT
