"""Pages to elements by windows: blocks, tables, skipped parts, character references, broken and long pages."""

from __future__ import annotations

import html

import pytest
from pyspark.sql import functions as F

from quern.sources import parsers
from quern.sources.html import html_parts, unescaped

PAGES = {
    "plain": ("one <b>two</b>\n three<br>four", [("NarrativeText", "one two three four", [])]),
    "blocks": ("<body>in<p>a<p>b</p>c<ul><li>d<li>e</ul><pre>f\n g</pre><blockquote>h</blockquote><figcaption>i</figcaption></body>", [
        ("NarrativeText", "in", []), ("NarrativeText", "a", []), ("NarrativeText", "b", []), ("NarrativeText", "c", []), ("ListItem", "d", []), ("ListItem", "e", []),
        ("Code", "f g", []), ("NarrativeText", "h", []), ("Figure", "i", [])]),
    "headings": ("<h1>A</h1><h3>B</h3>x<H2 class='>'>C</H2><p>y</p><h2></h2>z<h1>D</h1>w", [
        ("Title", "A", []), ("Title", "B", ["A"]), ("NarrativeText", "x", ["A", "B"]), ("Title", "C", ["A"]), ("NarrativeText", "y", ["A", "C"]), ("NarrativeText", "z", ["A", "C"]), ("Title", "D", []), ("NarrativeText", "w", ["D"])]),
    "skipped": ("<head><title>t</title></head>a<nav>b<nav>c</nav><h1>d</h1></nav>e<script>if (a</b) '<p>'</script>f<style>p{}</style><!-- <p>g -->h<noscript>i</noscript></nav>j<template>k", [
        ("NarrativeText", "a", []), ("NarrativeText", "efh", []), ("NarrativeText", "j", [])]),
    "table": ("<p>x</p><table><caption>cap</caption><tr><th>a</th><th><p>b</p><p>c</p></th></tr><tr></tr><tr><td></td><td>d<table><tr><td>e</td></tr></table>f</td></tr></table>y<table><tr><td>g", [
        ("NarrativeText", "x", []), ("Table", "cap\na | b c\nd\ne | f", []), ("NarrativeText", "y", []), ("Table", "g", [])]),
    "references": ("<p>&lt;b&gt; &amp;amp; &eacute; &#233;&#xE9; &nope; &amp &#0; &#1114112; &#128512; a&nbsp;b & &copy;</p>", [("NarrativeText", "<b> &amp; é éé &nope; &amp � � 😀 a b & ©", [])]),
    "broken": ("a < b <3 </> </table></nav><td>c</td><p title=\"x>y\" data='>'>d</p><", [("NarrativeText", "a < b <3 </>", []), ("NarrativeText", "c", []), ("NarrativeText", "d", []), ("NarrativeText", "<", [])]),
    "open comment": ("a<!-- b <p>c", [("NarrativeText", "a", [])]),
    "empty": ("", []),
    "null": (None, []),
    "tags only": ("<p></p><table><tr><td> </td></tr></table>", []),
}


def test_pages(spark):
    e = parsers.html_elements(spark.createDataFrame([(k, t) for k, (t, _) in PAGES.items()], "source_id string, text string"))
    got: dict[str, list] = {}
    for r in e.orderBy("source_id", "ord").collect():
        assert r["ord"] == len(got.setdefault(r["source_id"], []))
        got[r["source_id"]].append((r["type"], r["text"], r["section_path"]))
    for name, (_, want) in PAGES.items():
        assert got.get(name, []) == want, name


def test_no_python_worker_and_one_exchange(spark):
    e = parsers.html_elements(spark.createDataFrame([("a", "<p>x</p>")], "source_id string, text string"))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_references_like_the_standard_ones(spark):
    texts = ["&hearts;&Aacute;&NotEqualTilde;", "x &#38;lt; y", "&#x1F600;&#X41;", "&&amp;;&;", "no", "", None, "&notanentity; &amp;" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unescaped(F.col("t")).alias("u")).collect()
    for r in rows:
        assert r["u"] == (None if texts[r["i"]] is None else html.unescape(texts[r["i"]]).replace("¬anentity;", "&notanentity;"))


@pytest.mark.parametrize("page", ["<p>word " * 30_000, "<p " + "a='b' " * 3_000 + ">x</p>", "<div>" * 20_000 + "deep", "<table>" + "<tr><td>1</td></tr>" * 5_000, "<!--" + "-" * 500_000, "&amp;" * 100_000, "<" * 50_000])
def test_long_pages(spark, page):
    got = html_parts(spark.createDataFrame([(1, page)], "k int, text string"), "k", "text").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).first()
    want = {"<p>w": (30_000, 4), "<p a": (1, 1), "<div": (1, 4), "<tab": (1, 9_999), "<!--": (0, None), "&amp": (1, 100_000), "<<<<": (1, 50_000)}[page[:4]]
    assert (got["n"], got["longest"]) == want


def test_repeated_ids_and_other_columns(spark):
    d = spark.createDataFrame([("a", "<p>x</p>", 1, "y"), ("a", "<p>x</p>", 2, "z"), (None, "<h1>t</h1>", 3, "w")], "source_id string, text string, at int, tag string")
    assert sorted((r["source_id"] or "", r["ord"], r["text"]) for r in parsers.html_elements(d).collect()) == [("", 0, "t"), ("a", 0, "x"), ("a", 0, "x")]
    assert parsers.html_elements(d.limit(0)).count() == 0
    for key in ("row", "run", "tag", "level"):
        table = html_parts(spark.createDataFrame([(7, "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>")], f"{key} int, t string"), key, "t").first()
        assert table[key] == 7 and table["text"] == "a\nb"
