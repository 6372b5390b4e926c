"""Prose of pages against the standard library's parser."""

import time
from html.parser import HTMLParser

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.functions.html import REMOVED, VOID, html_text, prose


class Plain(HTMLParser):
    """A tree of open elements; an end tag closes the last element of its name and all within."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not REMOVED.intersection(self.open):
            self.texts.append(data)


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    return " ".join(" ".join(p.texts).split())[:10_000]


def test_all_pages():
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    assert len(pages) > 1000
    for page in pages:
        assert prose(page) == plain(page)


CASES = {
    '<p title="x > y">Hi</p>': "Hi",
    "<p title='a > b' data-x=1>Hi<br/>there</p>": "Hi there",
    "&copy; &#233; &mdash; &#x41; &amp;lt; &notit;": "© é — A &lt; ¬it;",
    "<nav>a<nav>b</nav>c</nav>d": "d",
    "<div><nav>a<p>b</div>c": "c",
    "<header>a<header>b</header></header>c</header>d": "c d",
    "a < b && c > d <3": "a < b && c > d <3",
    "<SCRIPT>x</ScRiPt >y": "y",
    "<script>if (a</b) '<nav>'</script>z<style>p{}</style>": "z",
    "<scripted>kept</scripted>": "kept",
    "<nav/>seen<script/>too": "seen too",
    "one<!-- <nav> - > -->two<!doctype html><?php x?>three": "one two three",
    "no&nbsp;break here": "no break here",
    "": "",
    "<": "<",
    "</>x</ >y": "x y",
    "<!--never closed <p>x": "",
    "<p>x<script>never closed": "x",
    "<a href=\"never closed": "",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert prose(page) == CASES[page]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<nav>", "</nav>", "<div a='>'>", "</div>", "<p>", "</p>", "text ", "x < y ", "<br>", "<!-- c -->", "&lt;", "<style>a</style>", '<b class="q">', "</b>", "<header id=1>", "</header>", "é "]), max_size=25).map("".join))
def test_nesting(page):
    assert prose(page) == plain(page)


@pytest.mark.parametrize("piece", ["<script>", "<nav>", "<!--", "<p ", '<a b="', "</", "&", "<div>", "<p a='x", "< ", "</nav>"])
def test_linear_time(piece):
    began = time.perf_counter()
    prose(piece * 200_000)
    assert time.perf_counter() - began < 5


def test_column(spark):
    df = spark.createDataFrame([(1, "<p>a</p>"), (2, None), (3, "")], "id int, h string")
    assert {r[0]: r[1] for r in df.select("id", html_text(df.h, 5)).collect()} == {1: "a", 2: None, 3: ""}


def test_query_keeps_references_without_semicolon(spark, tmp_path):
    from faultline.queries import html_to_text, oracle_sql

    pages = ["<p>les&&amp De</p>", "a &amp;lt; &lt;b&gt; &copy; &AMP; &amp", "x&nbsp;&nbsp;y&#39;s &quot;&#38;", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(oracle_sql()["html_to_text"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert dict(want)[0] == "les&&amp De"
    assert sorted(map(tuple, html_to_text(spark, str(tmp_path)).collect())) == sorted(want)
    assert prose(pages[0]) == "les&& De"  # as browsers read it
