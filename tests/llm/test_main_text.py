"""Main text: pages whose main text is known, broken markup, and the steps of the method by hand."""

import html as entities
import math
import re

import numpy as np
import pytest

from semaphora.llm import main_text as m

LONG = "A sentence with quite a number of words in it, so that its line has a high ratio of text to tags."


def test_table(spark, sf):
    """Every page of the table: what stands between the tags of its article."""
    from semaphora.llm.queries import main_text_query

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = main_text_query(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S).group(1)
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ")))
        want = "\n".join(p for p in parts if p)
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


BOILER = [
    '<div class="cookie-notice">We use cookies to make this site better for you.</div>',
    "<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>",
    '<header><a href="/">Site</a> <p>The slogan of the site, which is rather long for a slogan.</p></header>',
    '<aside><p>About the author of this page, who wrote many other pages, too many to name.</p></aside>',
    '<div id="sidebar"><p>' + LONG + "</p></div>",
    '<form action=x><label>Your mail</label><input name=q><button>Send</button></form>',
    "<script>if (a < b) { document.write('<p>no</p>'); }</script><style>p > a { color: red }</style>",
    '<section class="comments"><article><p>' + LONG + "</p></article></section>",
    '<div class="advert"><p>' + LONG + "</p></div>",
    '<div style="display: none">' + LONG + "</div>",
    "<footer>&copy; 2020 somebody</footer>",
]
BODY = f"<h1>The &amp; title</h1><p>{LONG}<p>Short.</p><ul><li>item one<li>item <b>two</b></ul><p>{LONG}</p><table><tr><td>cell</td><td>other</td></tr></table><p>The\n end&nbsp;of  it</p>"
TEXT = f"The & title\n{LONG}\nShort.\nitem one\nitem two\n{LONG}\ncell\nother\nThe end of it"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<main><article><header>{}</header></article></main>", '<div id="content">{}</div>', '<div class="page with-sidebar"><section>{}</section></div>'])
@pytest.mark.parametrize("before", range(len(BOILER) + 1))
def test_layouts(wrap, before):
    """Each kind of boilerplate, and all together, before and behind the main text."""
    around = BOILER[before : before + 1] or BOILER
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(around) + wrap.format(BODY) + "".join(around)
    assert m.main_text(page) == TEXT


def test_article_in_broken_markup():
    page = "<div class=menu>x<nav><a href=q>menu</a><article><p><b>Bold<br><p>Next</p></i></section>"
    assert m.main_text(page + "<p>Last") == "Bold\nNext\nLast"
    assert m.main_text(page + "</div><p>" + LONG) == "Bold\nNext"  # the article, however short
    assert m.main_text("<html><form>" + BODY + "</form>") == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   \n ", ""), ("<p></p>", ""), ("just text", "just text"), ("<p>a < b && c</p>", "a < b && c"), ("<p>one<!-- open <p>gone", "one"), ("<p>x</p><a href='", "x"),
        ("<![foo[ x ]]><p>y", "y"), ("<p>&#x41;&eacute;&lt;i&gt;&nosuch;</p>", "Aé<i>&nosuch;"), ("<?php echo 1 ?><p>z</p>", "z"), ("<script>alert(1)", ""), ("</p></p></div>q", "q"), ("<p/>w<br/>v", "w v"),
        ("<p>😀 漢字</p>".encode("utf-16", "surrogatepass").decode("utf-16"), "😀 漢字"), ("<nav>only a menu</nav>", ""), ("<!--><p>k", "k"),
    ],
)
def test_odd_pages(page, text):
    assert m.main_text(page) == text


def test_long_pages():
    assert m.main_text("<p>w " * 20_000).count("\n") == 19_999
    assert len(m.main_text("<div>" * 5_000 + "text")) == 4
    assert m.main_text("<a " * 20_000) == ""
    assert len(m.main_text("<article><p>" + "word " * 200_000)) == 999_999


def test_smoothing():
    ratios = [0.0, 10.0, 0.0, 0.0, 50.0]
    k = [math.exp(-(d**2) / 8) for d in range(-2, 3)]
    want = [sum(ratios[i + d] * k[d + 2] for d in range(-2, 3) if 0 <= i + d < 5) / sum(k) for i in range(5)]
    assert np.allclose(m.smoothed(np.array(ratios)), want)
    lines = [m.Line("x", int(r), 1, 0, False, -1) for r in ratios]
    assert m.clusters(lines).tolist() == [w >= np.std(want) for w in want]


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "t", 5), (1, "u", "<p>a</p>", "t", 5), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = m.extracted(pages, ["page_id", "url", "text", "n_chars"])
    assert got.columns == ["page_id", "url", "text_in", "n_chars_in", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "t", 5, "a", 1)] * 2 + [(None, None, None, None, "", 0)], key=str)
    assert m.extracted(pages.limit(0)).collect() == []
