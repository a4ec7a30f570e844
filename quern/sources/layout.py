"""Nested layout documents to elements: a document model's tree, kept as VARIANT and walked level by level.

A layout document names its items by references: body and groups list their
children, texts, tables and pictures hold label, text, level, provenance and
children of their own. Reading order is the walk of the tree, parents first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..plans.tables import written
from .markdown import open_headings, stripped

#: Arrays of a layout document whose entries are items, and those that only hold others.
ITEM_LISTS = ("texts", "tables", "pictures", "key_value_items")
LISTS = (*ITEM_LISTS, "groups")


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _references(value: Column) -> Column:
    """Texts of the `$ref` of an item's children, in order."""
    return F.transform(F.coalesce(_get(value, "$.children", "array<variant>"), F.array().cast("array<variant>")), lambda c: _get(c, "$['$ref']", "string"))


def items(documents: DataFrame) -> DataFrame:
    """(document_id, ref, list, item) of every entry of a layout document's arrays; documents: document_id, json. What is no JSON object has none."""
    parsed = documents.select("document_id", F.try_parse_json("json").alias("v"))
    entry = lambda name: F.transform(F.coalesce(_get(F.col("v"), f"$.{name}", "array<variant>"), F.array().cast("array<variant>")), lambda x, i: F.struct(F.lit(name).alias("list"), i.alias("n"), x.alias("item")))
    rows = parsed.select("document_id", F.explode(F.concat(*map(entry, LISTS))).alias("e")).select("document_id", "e.*")
    return rows.select("document_id", F.coalesce(_get(F.col("item"), "$.self_ref", "string"), F.concat(F.lit("#/"), "list", F.lit("/"), F.col("n").cast("string"))).alias("ref"), "list", "item")


def walk(documents: DataFrame, found: DataFrame, most_depth: int = 200) -> DataFrame:
    """(document_id, ref, path) of all that the body reaches: path holds the place under each ancestor, so that its order is reading order.

    One join for each level of the trees, on document and reference. A
    reference to an ancestor, or to nothing, leads nowhere, what a picture holds
    is not read, and an item that is listed twice is read where it comes first.
    """
    edges = written(found.where("list <> 'pictures'").select("document_id", F.col("ref").alias("parent"), F.posexplode(_references(F.col("item"))).alias("at", "ref")), "layout-edges")
    body = documents.select("document_id", F.try_parse_json("json").alias("v")).select("document_id", F.posexplode(_references(_get(F.col("v"), "$.body", "variant"))).alias("at", "ref"))
    level = written(body.select("document_id", "ref", F.array("at").alias("path"), F.array("ref").alias("above")), "layout-level")
    out = level
    for _ in range(most_depth):
        below = level.withColumnRenamed("ref", "parent").join(edges, ["document_id", "parent"]).where(~F.array_contains("above", F.col("ref")))
        level = written(below.select("document_id", "ref", F.concat("path", F.array("at")).alias("path"), F.concat("above", F.array("ref")).alias("above")), "layout-level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise ValueError(f"a layout tree is deeper than {most_depth}")
    return out.groupBy("document_id", "ref").agg(F.min("path").alias("path"))


def markdown_of_grid(item: Column) -> Column:
    """Pipe table of a table's grid of cells: the first row as header; null without a grid."""
    grid = F.transform(_get(item, "$.data.grid", "array<array<variant>>"), lambda row: F.transform(row, lambda c: stripped(F.coalesce(_get(c, "$.text", "string"), F.lit("")))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    dashes = line(F.transform(F.get(grid, F.lit(0)), lambda _: F.lit("---")))
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.array(line(F.get(grid, F.lit(0))), dashes), F.transform(F.slice(grid, 2, F.size(grid)), line)), "\n"))


def tree_elements(documents: DataFrame, types: dict[str, str], headings: list[str]) -> DataFrame:
    """Elements of nested layout documents (document_id, source_id, json) in reading order, with section paths and pages.

    A heading's level is its depth in the tree. Tables are their grid in
    markdown. Pages are the least and greatest of an item's provenance, 1
    without any. Items without a label or with a blank text, such as groups and
    most pictures, hold others but are no elements, as are those of another
    content layer than the body. A document that is no JSON has no elements.
    """
    held = written(items(documents), "layout-items")
    order = walk(documents, held)
    item = F.col("item")
    pages = F.transform(F.coalesce(_get(item, "$.prov", "array<variant>"), F.array().cast("array<variant>")), lambda p: _get(p, "$.page_no", "int"))
    text = F.coalesce(F.when(F.col("list") == "tables", markdown_of_grid(item)).otherwise(_get(item, "$.text", "string")), F.lit(""))
    in_body = F.coalesce(_get(item, "$.content_layer", "string"), F.lit("body")) == "body"
    rows = held.where(F.col("list").isin(*ITEM_LISTS) & in_body).join(order, ["document_id", "ref"]).select(
        "document_id", "path", F.lower(_get(item, "$.label", "string")).alias("label"), text.alias("text"), F.size("path").alias("level"),
        F.coalesce(F.array_min(pages), F.lit(1)).alias("start_page"), F.coalesce(F.array_max(pages), F.lit(1)).alias("end_page"),
    )
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("path")) - 1
    rows = written(rows.where((stripped(F.col("text")) != "") & F.col("label").isNotNull()).withColumns({"ord": n, "heads": F.col("label").isin(headings)}), "layout-rows")
    deepest = rows.where("heads").agg(F.max("level")).first()[0] or 1
    table = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    named = rows.withColumns({"section_path": open_headings(rows, "document_id", "ord", F.col("heads"), "level", "text", range(1, deepest + 1)), "type": F.coalesce(F.try_element_at(table, F.col("label")), F.lit("NarrativeText"))})
    return named.join(documents.select("document_id", "source_id"), "document_id").select(
        "document_id", "source_id", "ord", "type", "text", "section_path", "level", stable_id(F.col("document_id"), F.col("ord"), F.col("type")).alias("element_id"), "start_page", "end_page",
    )
