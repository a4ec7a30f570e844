from __future__ import annotations

import json

from quern.sources import layout, parsers


def ref(name):
    return {"$ref": name}


def doc():
    texts = [
        {"self_ref": "#/texts/0", "label": "title", "text": " Report ", "level": 3, "prov": [{"page_no": 1}]},
        {"self_ref": "#/texts/1", "label": "section_header", "text": "Part B", "level": 2, "children": [ref("#/texts/2"), ref("#/tables/0")], "prov": [{"page_no": 4}, {"page_no": 3}]},
        {"self_ref": "#/texts/2", "label": "paragraph", "text": "under B", "children": [ref("#/texts/1")]},  # back to its parent
        {"self_ref": "#/texts/3", "label": "section_header", "text": "Part A", "level": 2},
        {"self_ref": "#/texts/4", "label": "list_item", "text": "item"},
        {"self_ref": "#/texts/5", "label": "strange", "text": "lost", "prov": "none"},
        {"label": "footnote", "text": "note"},  # no reference of its own
        {"self_ref": "#/texts/7", "label": "text", "text": "   "},
        {"self_ref": "#/texts/8", "label": "page_header", "text": "top", "content_layer": "furniture"},
        {"self_ref": "#/texts/9", "text": "no label"},
    ]
    return {
        "body": {"children": [ref("#/texts/0"), ref("#/groups/0"), ref("#/texts/1"), ref("#/nowhere/1"), ref("#/texts/6"), ref("#/texts/7"), ref("#/texts/8"), ref("#/texts/9"), ref("#/texts/4")]},
        "groups": [{"self_ref": "#/groups/0", "children": [ref("#/texts/3"), ref("#/groups/1")]}, {"self_ref": "#/groups/1", "children": [ref("#/texts/4"), ref("#/pictures/0")]}],
        "texts": texts,
        "tables": [{"self_ref": "#/tables/0", "label": "table", "data": {"grid": [[{"text": "a"}, {"text": "b"}], [{"text": "1"}, {"text": None}]]}}],
        "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "text": "a chart", "children": [ref("#/texts/5")]}],
    }


def test_tree_in_reading_order(spark):
    df = spark.createDataFrame([("d", "s", json.dumps(doc())), ("bad", "s", "{oops"), ("none", "s", None), ("list", "s", "[1]"), ("empty", "s", "{}")], "document_id string, source_id string, json string")
    types, headings = parsers.LAYOUTS["docling"]
    rows = layout.tree_elements(df, types, headings).orderBy("document_id", "ord").collect()
    assert {r["document_id"] for r in rows} == {"d"} and [r["ord"] for r in rows] == list(range(len(rows)))
    assert [(r["type"], r["text"], list(r["section_path"]), r["start_page"], r["end_page"]) for r in rows] == [
        ("Title", " Report ", [], 1, 1), ("Title", "Part A", [" Report "], 1, 1), ("ListItem", "item", [" Report ", "Part A"], 1, 1), ("Figure", "a chart", [" Report ", "Part A"], 1, 1),
        ("Title", "Part B", [], 3, 4), ("NarrativeText", "under B", ["Part B"], 1, 1), ("Table", "| a | b |\n| --- | --- |\n| 1 |  |", ["Part B"], 1, 1),
        ("NarrativeText", "note", ["Part B"], 1, 1),
    ]
    plan = layout.tree_elements(df, types, headings)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
