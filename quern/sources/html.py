"""HTML to elements by windows over tags and texts: what a scanner keeps in variables is data here.

Whether a text is skipped or in a table is a depth, a running sum that never
falls below zero; blocks are runs from one block tag to the next, and a table's
cells are grouped by row. No Python worker runs.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK
from .markdown import open_headings, stripped

RAW = ("script", "style")
SKIPPED = ("nav", "noscript", "template", "head")
CELLS = ("table", "tr", "td", "th")
HEADINGS = tuple(f"h{n}" for n in range(1, 7))
KINDS = {"p": "NarrativeText", "li": "ListItem", "pre": "Code", "figcaption": "Figure", "blockquote": "NarrativeText", "div": "NarrativeText", "body": "NarrativeText"}
#: Comments, raw elements with what they hold, tags, declarations, texts, and a `<` that opens nothing.
TOKEN = "|".join([r"(?is)<!--.*?(?:-->|\z)", *(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in RAW), r"""</?[a-z](?:"[^"]*"|'[^']*'|[^'">]++)*+>""", r"<[!?][^>]*>", "[^<]+", "<"])
TAG = r"(?s)^</?([A-Za-z][^\s/>]*).*>$"
REFERENCE = r"[^&]+|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});|&"
#: Frequent references, looked up before the table of all names.
FREQUENT = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"'}


def character(code: Column) -> Column:
    """The character of a code point; U+FFFD for numbers that are none."""
    good = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def unescaped(text: Column) -> Column:
    """text with its character references resolved: numbers and the names of HTML, all with their `;`. Others stay."""
    names = F.from_json(F.lit(json.dumps({f"&{n}": c for n, c in html5.items() if n.endswith(";")})), "map<string,string>")

    def one(p: Column) -> Column:
        number = F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(F.regexp_extract(p, "([0-9]+);$", 1)).cast("long")
        usual = reduce(lambda w, kv: w.when(p == kv[0], kv[1]), FREQUENT.items(), F.when(~F.startswith(p, F.lit("&")) | (p == "&"), p))
        return usual.when(F.startswith(p, F.lit("&#")), character(number)).otherwise(F.coalesce(F.try_element_at(names, p), p))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one), "")).otherwise(text)


def tokens(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, tag, opens, text) of a page's tags (tag in lower case) and texts (tag null); comments, declarations, scripts and styles are left out."""
    cut = sources.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    token = F.col("token")
    tag = F.when(token.rlike(TAG), F.lower(F.regexp_extract(token, TAG, 1)))
    known = cut.withColumn("tag", tag).where((F.col("tag").isNotNull() & ~F.col("tag").isin(*RAW)) | (~token.rlike("(?s)^<.")))
    return known.select(key, "at", "tag", (~F.startswith("token", F.lit("</"))).alias("opens"), F.when(F.col("tag").isNull(), unescaped(token)).when(F.col("tag") == "br", " ").alias("text"))


def depth(tags: tuple[str, ...], by: str) -> tuple[Column, Column]:
    """(sum, order window): how often the tags opened and did not close, as a running sum that may fall below zero."""
    order = Window.partitionBy(by).orderBy("at")
    step = F.when(~F.coalesce(F.col("tag").isin(*tags), F.lit(False)), 0).when(F.col("opens"), 1).otherwise(-1)
    return F.sum(step).over(order), order


def nested(rows: DataFrame, tags: tuple[str, ...], by: str, name: str) -> DataFrame:
    """rows with the depth of the tags, an opening tag being inside; a closing tag without an open one changes nothing."""
    total, order = depth(tags, by)
    return rows.withColumn("__s", total).withColumn(name, F.col("__s") - F.least(F.lit(0), F.min("__s").over(order))).drop("__s")


def html_parts(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, type, text, section_path, level) of each part of a page, in reading order.

    Blocks begin and end at block tags; white space within them is one space. A
    text outside every block is narrative. Navigation, head, noscript and
    template are left out with all they hold, to the page's end if not closed.
    A table is one part, rows on lines and cells with ` | ` between them, empty
    ones left out; a table inside a cell adds its rows, a caption is a row. An
    unclosed table or block ends with the page. A null or empty text has no part.

    key must tell the rows of sources apart and may have any name. One exchange
    by key serves all windows and groups; they spill, so a page may be as long
    as a row can be.
    """
    given, key = key, "__key"
    sources = sources.select(F.col(given).alias(key), F.col(text).alias("text"))
    text = "text"
    order = Window.partitionBy(key).orderBy("at")
    shown = nested(tokens(sources, key, text), SKIPPED, key, "skip").where("skip = 0")
    placed = nested(shown, ("table",), key, "inside")
    tag, inside = F.col("tag"), F.col("inside") > 0
    is_block = F.coalesce(tag.isin(*KINDS, *HEADINGS, *SKIPPED), F.lit(False))
    is_cell = F.coalesce(tag.isin(*CELLS), F.lit(False))
    first = (tag == "table") & F.col("opens") & (F.col("inside") == 1)
    cut = placed.withColumns({
        "run": F.sum(F.when(is_cell | (is_block & ~inside), 1).otherwise(0)).over(order),
        "row": F.sum(F.when((tag == "tr") & F.col("opens"), 1).otherwise(0)).over(order),
        "nth": F.sum(F.when(first, 1).otherwise(0)).over(order),
        "text": F.when(is_block & inside, " ").otherwise(F.col("text")),
        "kind": F.when(is_block & F.col("opens") & ~inside, F.when(tag.isin(*HEADINGS), "Title").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), tag))),
        "level": F.when(tag.isin(*HEADINGS) & F.col("opens") & ~inside, F.substring(tag, 2, 1).cast("int")),
    })
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda t: t["text"]), "")
    runs = cut.groupBy(key, "run", "row", "nth", inside.alias("table")).agg(stripped(F.regexp_replace(words, f"{BLANK}+", " ")).alias("text"), F.max("kind").alias("kind"), F.max("level").alias("level")).where("text <> ''")
    blocks = runs.where("not table").select(key, "run", F.coalesce("kind", F.lit("NarrativeText")).alias("type"), "text", "level")
    listed = lambda by, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda c: c["text"]), sep)
    rows = runs.where("table").groupBy(key, "nth", "row").agg(listed("run", " | ").alias("text"), F.min("run").alias("run"))
    tables = rows.groupBy(key, "nth").agg(listed("row", "\n").alias("text"), F.min("run").alias("run")).select(key, "run", F.lit("Table").alias("type"), "text", F.lit(None).cast("int").alias("level"))
    parts = blocks.unionByName(tables)
    out = parts.withColumn("section_path", open_headings(parts, key, "run", F.col("type") == "Title", "level", "text"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1
    return out.select(F.col(key).alias(given), n.alias("ord"), "type", "text", "section_path", F.coalesce("level", F.lit(0)).alias("level"))
