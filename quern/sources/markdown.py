"""Markdown to elements by windows over lines: what a scanner keeps in variables is data here.

Whether a line is code is the parity of the fences so far, runs of table rows
and of text lines are islands, and the open headings are the last ones of each
level that no later heading of a lower level closes. No Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK

#: Line ends as str.splitlines() of Python sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
LEVELS = range(1, 7)
FENCE = rf"^{BLANK}*```"
HEADING = rf"^#{{1,6}}{BLANK}+(.*)$"
TABLE_ROW = rf"^{BLANK}*\|.*\|{BLANK}*$"
ITEM = rf"^{BLANK}*(?:[-*+]|\p{{Nd}}+\.){BLANK}+(.+)$"
TYPES = {"code": "Code", "heading": "Title", "table": "Table", "item": "ListItem", "text": "NarrativeText"}


def stripped(text: Column) -> Column:
    """Without white space at both ends, as str.strip() of Python."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def lines(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line, fence, kind, level, body) of every line, fences left aside in kind; a null text is one empty line."""
    cut = sources.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), LINE_END)).alias("at", "line"))
    line = F.col("line")
    kind = F.when(line.rlike(HEADING), "heading").when(line.rlike(TABLE_ROW), "table").when(line.rlike(ITEM), "item").when(stripped(line) == "", "blank").otherwise("text")
    named = cut.withColumns({"fence": line.rlike(FENCE), "kind": kind})
    body = F.when(F.col("kind") == "heading", F.regexp_extract("line", HEADING, 1)).when(F.col("kind") == "item", F.regexp_extract("line", ITEM, 1)).otherwise(line)
    return named.withColumns({"level": F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1))), "body": body})


def runs(marked: DataFrame, key: str) -> DataFrame:
    """(key, run, kind, level, text): code blocks, table and text islands, and the other lines one by one, in order; text may be empty."""
    order = Window.partitionBy(key).orderBy("at")
    state = marked.withColumn("fences", F.sum(F.col("fence").cast("int")).over(order))
    state = state.withColumn("kind", F.when(F.col("fences") % 2 == 1, "code").when(F.col("fence"), "close").otherwise(F.col("kind")))
    alone = ~F.col("kind").isin("code", "table", "text") | F.col("fence")
    new = alone | F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True))
    island = state.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    held = F.transform(F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("at", F.when(F.col("kind") == "code", F.col("line")).otherwise(F.col("body")).alias("body"))))), lambda x: x["body"])
    level = F.max(F.when(F.col("kind") == "heading", F.col("level"))).alias("level")
    joined = island.groupBy(key, "run", "kind").agg(held.alias("held"), level)
    return joined.select(key, "run", "kind", "level", stripped(F.when(F.col("kind") == "text", F.array_join("held", " ")).otherwise(F.array_join("held", "\n"))).alias("text"))


def open_headings(rows: DataFrame, key: str, order: str, heading: Column, level: str, text: str, levels: range = LEVELS) -> Column:
    """Texts of the headings that are open before a row; a heading closes those of its level and deeper ones.

    The last heading of each level is a running maximum; it is open if it is of a
    lower level than the row and comes after the last heading of each lower level.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max(F.when(heading & (F.col(level) == n), F.struct(F.col(order).alias("at"), F.col(text).alias("text")))).over(before) for n in levels}
    own = F.when(heading, F.col(level)).otherwise(levels.stop)
    still = [
        F.when(F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(last[k]["at"], F.lit(-1)) for k in levels if k < n)) < last[n]["at"], F.when(own > n, last[n]["text"])) for n in levels
    ]
    return F.filter(F.array(*still), lambda t: t.isNotNull())


def markdown_parts(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, type, text, section_path, level) of each part of a markdown text, in reading order.

    key must tell the rows of sources apart; a row without a part has no row here.
    One exchange by key serves all windows and groups; they spill, so a text may
    be as long as a row can be. level is a heading's, else 0. Code ends with the
    text where its fence is not closed; a heading without a text opens its level
    but is no part.
    """
    found = runs(lines(sources, key, text), key)
    placed = found.withColumn("section_path", open_headings(found, key, "run", F.col("kind") == "heading", "level", "text"))
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    kept = placed.withColumn("type", F.try_element_at(table, F.col("kind"))).where((F.col("text") != "") & F.col("type").isNotNull())
    n = F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1
    return kept.select(key, n.alias("ord"), "type", "text", "section_path", F.coalesce("level", F.lit(0)).alias("level"))
