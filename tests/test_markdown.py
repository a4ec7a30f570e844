from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quern.sources import markdown, parsers

KINDS = [("heading", re.compile(r"(#{1,6})\s+(.*)$")), ("table", re.compile(r"\s*\|.*\|\s*$")), ("item", re.compile(r"\s*(?:[-*+]|\d+\.)\s+(.+)$"))]


def scan(text):
    """The elements by one pass over the lines: (type, text, open headings, level)."""
    out, stack, held, kind, code = [], [], [], "", None

    def put(name, body, level=0):
        if body.strip():
            out.append((name, body.strip(), [t for _, t in stack], level))

    def flush():
        nonlocal kind
        if held:
            put("Table" if kind == "table" else "NarrativeText", ("\n" if kind == "table" else " ").join(held))
        held.clear()
        kind = ""

    for line in (text or "").splitlines():
        if re.match(r"\s*```", line):
            if code is None:
                flush()
                code = []
            else:
                put("Code", "\n".join(code))
                code = None
            continue
        if code is not None:
            code.append(line)
            continue
        now, m = next(((k, p.match(line)) for k, p in KINDS if p.match(line)), ("text" if line.strip() else "blank", None))
        if now != kind:
            flush()
        kind = now
        if now == "heading":
            level, title = len(m[1]), m[2].strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            put("Title", title, level)
            stack.append((level, title))
        elif now == "item":
            put("ListItem", m[1])
        elif now in ("table", "text"):
            held.append(line)
    flush()
    if code is not None:
        put("Code", "\n".join(code))
    return out


PIECES = ["# One", "## Two  ", "### Three", "###### Six", "####### seven", "#none", "#  ", "| a | b |", "  |---|", "|x", "- item", "* ", " 12. twelve", "1.no", "٣. three", "```", "  ```py", "text here", "  more\ttext ", "", "   ", " ", "end of line", "a\x0bb", "x\r\ny", "\x1c"]


def texts(n=400):
    rng = random.Random(4)
    return [None, "", "```", "# only", *("\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(n))]


def test_markdown_equals_a_line_scanner(spark):
    all_texts = texts()
    df = spark.createDataFrame([(f"s{i % 300}", i, t) for i, t in enumerate(all_texts)], "source_id string, n int, text string").repartition(3)
    got = {}
    for r in markdown.markdown_parts(df, "n", "text").orderBy("n", "ord").collect():
        assert r["ord"] == len(got.setdefault(r["n"], []))
        got[r["n"]].append((r["type"], r["text"], list(r["section_path"]), r["level"]))
    assert {n: v for n, v in enumerate(map(scan, all_texts)) if v} == got
    whole = parsers.markdown_elements(df).count()  # rows of one source stay apart
    assert whole == sum(map(len, map(scan, all_texts)))


def test_markdown_runs_without_python_and_one_exchange(spark):
    df = spark.createDataFrame([(1, "a")], "n int, text string")
    plan = markdown.markdown_parts(df, "n", "text")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and plan.count("Exchange") == 1


def test_parse_keeps_order_and_errors(spark):
    rows = [("a", "text/markdown", "# T\n\nbody"), ("b", "text/plain", "x\n\ny"), ("c", "text/html", "<p>h</p>"), ("d", "image/png", "x"), ("e", "text/markdown", None), ("f", "text/markdown", "")]
    done = parsers.outlines(spark.createDataFrame(rows, "source_id string, media_type string, text string").coalesce(1)).orderBy("ord").collect()
    assert [r["source_id"] for r in done] == list("abcdef")
    assert [None if r["parts"] is None else len(r["parts"]) for r in done] == [2, 2, 1, None, None, 0]
    assert [r["error"] is None for r in done] == [True, True, True, False, False, True]


def test_layout_levels_beyond_six_and_block_ties(spark):
    items = spark.createDataFrame([("d", i, f'{{"type": "heading", "content": "{t}", "heading_level": {n}}}') for i, (t, n) in enumerate([("A", 1), ("B", 9), ("C", 6), ("D", 0)])], "document_id string, ord int, json string").withColumn("source_id", F.lit("s"))
    assert [list(r["section_path"]) for r in parsers.layout_elements(items).orderBy("ord").collect()] == [[], ["A"], ["A"], []]
    blocks = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, "same", i) for i in (3, 1, 2)], "document_id string, page int, x double, y double, page_height double, text string, at int")
    assert [r["at"] for r in parsers.block_order(blocks, "at").orderBy("ord").collect()] == [1, 2, 3]
