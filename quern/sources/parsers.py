"""Sources to elements: plain text, markdown, HTML, zipped-XML office files, layout JSON, page blocks.

sources: source_id, media_type, and text or content (binary), optional filename.
Every parser gives documents (document_id, source_id, title, parser_name,
parser_version, media_type) nested with elements; `elements()` flattens them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, stable_id
from .html import html_parts
from .layout import tree_elements
from .markdown import LEVELS, markdown_parts, open_headings

MEDIA = {"text/markdown": "markdown", "text/plain": "markdown", "text/html": "html", "application/hwp+zip": "hwpx", "application/x-hwp": "hwp", "application/pdf": "pdf"}
VERSION = "1.0.0"
PARTS = "array<struct<type:string,text:string,section_path:array<string>,level:int>>"


def read_text(content: Column, text: Column) -> Column:
    """Text of a source: given text wins over bytes, which are UTF-8 (others: null)."""
    return F.coalesce(text, F.try_validate_utf8(content.cast("string")))


def parser_of(media_type: Column) -> Column:
    """First parser that takes the media type; null if none does."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    return F.when(media_type.isin(list(MEDIA)), F.try_element_at(table, media_type))


def document_id(source_id: Column, media_type: Column, parser: Column) -> Column:
    return stable_id(source_id, media_type, parser)


def plain_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, their lines joined by a space."""
    lines = F.regexp_replace(text, r"\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]", "\n")
    blocks = F.split(lines, rf"\n(?:[^\S\n]*\n)+")
    joined = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_replace(b, "\n", " "), f"^{BLANK}+|{BLANK}+$", ""))
    return F.filter(joined, lambda b: b != "")


def plain_elements(sources: DataFrame, source_id: str = "source_id", text: str = "text", media_type: str = "text/plain") -> DataFrame:
    """Elements of plain texts, by expressions alone: one narrative element for each paragraph."""
    doc = document_id(F.col(source_id), F.lit(media_type), F.lit("markdown"))
    rows = sources.select(F.col(source_id).cast("string").alias("source_id"), doc.alias("document_id"), F.posexplode(plain_paragraphs(F.col(text))).alias("ord", "text"))
    return rows.select(
        "document_id", "source_id", "ord", F.lit("NarrativeText").alias("type"), "text", F.array().cast("array<string>").alias("section_path"),
        stable_id(F.col("document_id"), F.col("ord"), F.lit("NarrativeText")).alias("element_id"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"),
    )


class Outline:
    """Elements under a stack of headings."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []
        self.out: list[dict] = []

    def add(self, kind: str, text: str, level: int = 0) -> None:
        text = text.strip()
        if kind == "Title":
            while self.stack and self.stack[-1][0] >= level:
                self.stack.pop()
        if text:
            self.out.append({"type": kind, "text": text, "section_path": [t for _, t in self.stack], "level": level})
        if kind == "Title":
            self.stack.append((level, text))


def short_line_is_title(text: str) -> bool:
    return len(text) <= 40 and not text.endswith((".", "!", "?"))


def lines_outline(lines: list[str]) -> list[dict]:
    """Short lines without an end mark are titles, each the only section of what follows."""
    out = Outline()
    for line in lines:
        if line.strip():
            title = short_line_is_title(line.strip())
            out.add("Title" if title else "NarrativeText", line, 1)
    return out.out


def hwpx_outline(content: bytes) -> list[dict]:
    """Numbered section files of the zip: tables as `a | b` lines, paragraphs outside tables as lines."""
    out = Outline()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
        for name in names:
            _walk_hwpx(ElementTree.fromstring(z.read(name)), out)
    return out.out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _words_of(node: ElementTree.Element) -> str:
    return "".join(t for t in node.itertext()).strip()


def _walk_hwpx(node: ElementTree.Element, out: Outline) -> None:
    for child in node:
        tag = _local(child.tag)
        if tag == "tbl":
            rows = [[_words_of(c) for c in r if _local(c.tag) == "tc"] for r in child.iter() if _local(r.tag) == "tr"]
            out.add("Table", "\n".join(" | ".join(r) for r in rows))
        elif tag == "p" and not any(_local(x.tag) == "tbl" for x in child.iter()):
            if text := _words_of(child):
                out.add("Title" if short_line_is_title(text) else "NarrativeText", text, 1)
        else:
            _walk_hwpx(child, out)


OUTLINES: dict[str, Callable] = {"application/x-hwp": lambda t: lines_outline(t.splitlines())}


def outlines(sources: DataFrame) -> DataFrame:
    """(source_id, document_id, ord, parts, error): what each source of any supported type holds, ord in the order of the rows.

    Markdown and HTML are parsed by windows over lines and tags, plain text by
    expressions; office files go through a Python function. A source that no parser
    takes, or that its parser can't read, has an error and no parts; the batch
    goes on.
    """

    @F.pandas_udf(f"struct<parts:{PARTS},error:string>")
    def outline(kind: pd.Series, text: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for k, t, c in zip(kind, text, content, strict=True):
            try:
                rows.append((hwpx_outline(bytes(c)) if k == "application/hwp+zip" else OUTLINES[k](t), None))
            except (KeyError, ValueError, TypeError, zipfile.BadZipFile, ElementTree.ParseError, AttributeError) as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["parts", "error"])

    content = F.col("content") if "content" in sources.columns else F.lit(None).cast("binary")
    base = sources.select(
        F.col("source_id").cast("string").alias("source_id"), "media_type", F.monotonically_increasing_id().alias("ord"),
        (read_text(content, F.col("text")) if "content" in sources.columns else F.col("text")).alias("text"), content.alias("content"),
    )
    doc = document_id(F.col("source_id"), F.col("media_type"), parser_of(F.col("media_type"))).alias("document_id")
    named = base.select("source_id", "media_type", doc, "ord", "text", "content")
    out = ["source_id", "document_id", "ord", "parts", "error"]
    written = F.coalesce("media_type", F.lit("")).isin("text/markdown", "text/plain", "text/html")
    other = named.where(~written).withColumn("r", outline("media_type", "text", "content")).select("source_id", "document_id", "ord", "r.parts", "r.error")
    nothing = F.when(F.col("text").isNull(), "TypeError: no text").alias("error")
    paragraph = lambda t: F.struct(F.lit("NarrativeText").alias("type"), t.alias("text"), F.array().cast("array<string>").alias("section_path"), F.lit(0).alias("level"))
    plain = named.where("media_type = 'text/plain'").select("source_id", "document_id", "ord", F.transform(plain_paragraphs(F.col("text")), paragraph).cast(PARTS).alias("parts"), nothing)
    marked, pages = (_listed(named.where(F.col("media_type") == kind), parts) for kind, parts in (("text/markdown", markdown_parts), ("text/html", html_parts)))
    return other.select(out).unionByName(plain.select(out)).unionByName(marked.select(out)).unionByName(pages.select(out))


def _listed(marked: DataFrame, parts_of: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """outlines() of sources that windows parse: the parts of each in one array."""
    parts = parts_of(marked.select(F.col("ord").alias("row"), "text"), "row", "text")
    one = F.struct("ord", "type", "text", "section_path", "level")
    lists = parts.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("l"))
    whole = marked.select("source_id", "document_id", "ord", F.col("text").isNull().alias("none")).join(lists, F.col("ord") == F.col("row"), "left")
    got = F.transform(F.coalesce("l", F.array().cast("array<struct<ord:int,type:string,text:string,section_path:array<string>,level:int>>")), lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), p["section_path"].alias("section_path"), p["level"].alias("level")))
    return whole.select("source_id", "document_id", "ord", F.when(~F.col("none"), got).cast(PARTS).alias("parts"), F.when(F.col("none"), "TypeError: no text").alias("error"))


def elements_of(done: DataFrame) -> DataFrame:
    """Elements of outlines()."""
    rows = done.where("error is null").select("document_id", "source_id", F.posexplode("parts").alias("ord", "p"))
    return rows.select("document_id", "source_id", "ord", "p.*").withColumns({"element_id": stable_id(F.col("document_id"), F.col("ord"), F.col("type")), "start_page": F.lit(1), "end_page": F.lit(1)})


def parse(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, failures) of sources of any supported type; failures: source_id, error."""
    done = outlines(sources)
    return elements_of(done), done.where("error is not null").select("source_id", "error")


def _elements(sources: DataFrame, source_id: str, text: str, media_type: str, parser: str, parts_of: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    named = sources.select(F.col(source_id).cast("string").alias("source_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    key = F.struct("source_id", "row").alias("of")
    doc = document_id(F.col("of.source_id"), F.lit(media_type), F.lit(parser))
    rows = parts_of(named.select(key, "text"), "of", "text").select(doc.alias("document_id"), F.col("of.source_id").alias("source_id"), "ord", "type", "text", "section_path", "level")
    return rows.withColumns({"element_id": stable_id(F.col("document_id"), F.col("ord"), F.col("type")), "start_page": F.lit(1), "end_page": F.lit(1)})


def markdown_elements(sources: DataFrame, source_id: str = "source_id", text: str = "text") -> DataFrame:
    """Elements of markdown texts, by windows alone; rows of one source_id are parsed one by one."""
    return _elements(sources, source_id, text, "text/markdown", "markdown", markdown_parts)


def html_elements(sources: DataFrame, source_id: str = "source_id", text: str = "text") -> DataFrame:
    """Elements of pages, by windows alone; rows of one source_id are parsed one by one."""
    return _elements(sources, source_id, text, "text/html", "html", html_parts)


def titles(elements: DataFrame) -> DataFrame:
    """(document_id, title): the first heading of level one."""
    return elements.where("type = 'Title' and level = 1").groupBy("document_id").agg(F.min_by("text", "ord").alias("title"))


def block_order(blocks: DataFrame, ties: str | None = None) -> DataFrame:
    """Reading order of page blocks (document_id, page, x, y, page_height, text): by page, rounded y and x; short top blocks are titles.

    Blocks of one place keep the order of the column `ties`, then of their text.
    """
    order = Window.partitionBy("document_id").orderBy("page", F.round("y", 1), F.round("x", 1), *([ties] if ties else []), "text")
    title = (F.length(F.trim("text")) <= 80) & ~F.trim("text").contains("\n") & (F.col("y") < F.col("page_height") * 0.25)
    return blocks.where(F.trim("text") != "").withColumns({"ord": F.row_number().over(order) - 1, "type": F.when(title, "Title").otherwise("NarrativeText"), "section_path": F.array().cast("array<string>")})


def page_features(pages: DataFrame) -> DataFrame:
    """has_text_layer, image_area_ratio and char_count of pages (text, images array<struct<w,h>>, width, height)."""
    area = F.aggregate("images", F.lit(0.0), lambda s, i: s + i["w"] * i["h"])
    page = F.col("width") * F.col("height")
    return pages.withColumns({"has_text_layer": F.length(F.trim("text")) > 0, "image_area_ratio": F.when(page > 0, F.least(F.lit(1.0), area / page)).otherwise(0.0), "char_count": F.length("text")})


def page_route(has_text: Column, image_ratio: Column) -> Column:
    """OCR for image pages without text and for empty ones, TEXT otherwise."""
    return F.when(~has_text & (image_ratio > 0.5), "OCR").when(has_text, "TEXT").otherwise("OCR")


def route_pages(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Text of each page by its route; ocr: (image_sha, ocr_text), looked up by the digest of the page image."""
    routed = page_features(pages).withColumn("route", page_route(F.col("has_text_layer"), F.col("image_area_ratio")))
    found = routed.withColumn("image_sha", F.sha2("image", 256)).join(ocr, "image_sha", "left")
    by_ocr = F.col("route") == "OCR"
    return found.withColumns({
        "text": F.when(by_ocr, F.coalesce("ocr_text", F.lit(""))).otherwise(F.col("text")),
        "ocr_confidence": F.when(by_ocr, F.when(F.coalesce(F.length("ocr_text"), F.lit(0)) > 0, 1.0).otherwise(0.0)),
    }).drop("ocr_text", "image_sha")


def ocr_confidence(scores: Column) -> Column:
    """Mean of the non-negative word scores, as a share; none: 0."""
    good = F.filter(scores, lambda s: s >= 0)
    return F.when(F.size(good) == 0, 0.0).otherwise(F.aggregate(good, F.lit(0.0), lambda a, s: a + s) / F.size(good) / 100.0)


#: Labels of two layout models and what they become (fixed); others are narrative text.
DOCLING_TYPES = {
    "title": "Title", "section_header": "Title", "text": "NarrativeText", "paragraph": "NarrativeText", "caption": "NarrativeText", "footnote": "NarrativeText", "list_item": "ListItem",
    "table": "Table", "picture": "Figure", "chart": "Figure", "code": "Code", "formula": "Formula", "page_header": "PageHeader", "page_footer": "PageFooter",
}
OPENDATALOADER_TYPES = {
    "heading": "Title", "paragraph": "NarrativeText", "table": "Table", "image": "Figure", "picture": "Figure", "chart": "Figure", "formula": "Formula", "list": "ListItem",
    "caption": "NarrativeText", "footnote": "NarrativeText", "page_header": "PageHeader", "page_footer": "PageFooter",
}
LAYOUTS = {"docling": (DOCLING_TYPES, ["title", "section_header"]), "opendataloader": (OPENDATALOADER_TYPES, ["heading"])}


def layout_elements(items: DataFrame, layout: str = "opendataloader") -> DataFrame:
    """Elements of layout JSON rows (document_id, source_id, ord, json) with section paths.

    json: type, content, page_number, heading_level, bounding_box, ocr_engine.
    Items without content are left out. A heading closes the open headings of
    its level and deeper ones; the section path of an item is the headings
    that are open before it. Levels beyond six count as six. route: ocr with an OCR engine, vlm for images,
    else text.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    types, headings = LAYOUTS[layout]
    j = F.from_json("json", "type string, content string, page_number int, heading_level int, bounding_box string, ocr_engine string")
    kind = F.lower(F.coalesce("j.type", F.lit("paragraph")))
    level = F.greatest(F.lit(1), F.least(F.lit(len(LEVELS)), F.coalesce("j.heading_level", F.lit(1))))
    rows = items.withColumn("j", j).select("document_id", "source_id", "ord", kind.alias("kind"), F.trim(F.coalesce("j.content", F.lit(""))).alias("text"), F.coalesce("j.page_number", F.lit(1)).alias("page"), level.alias("level"), "j.bounding_box", "j.ocr_engine")
    rows = rows.where("text <> ''").withColumn("heads", F.col("kind").isin(headings))
    table = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    named = rows.withColumns({"section_path": open_headings(rows, "document_id", "ord", F.col("heads"), "level", "text"), "type": F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("NarrativeText")), "n": F.row_number().over(Window.partitionBy("document_id").orderBy("ord")) - 1})
    route = F.when(F.coalesce("ocr_engine", F.lit("")) != "", "ocr").when(F.col("kind") == "image", "vlm").otherwise("text")
    return named.select("document_id", "source_id", F.col("n").alias("ord"), "type", "text", "section_path", "level", stable_id(F.col("document_id"), F.col("n"), F.col("type")).alias("element_id"), F.col("page").alias("start_page"), F.col("page").alias("end_page"), "bounding_box", route.alias("route"))


def layout_tree_elements(documents: DataFrame) -> DataFrame:
    """Elements of nested layout documents (document_id, source_id, json) of the first of the two models; see layout.tree_elements()."""
    return tree_elements(documents, *LAYOUTS["docling"])


def pipe_table(header: Column, rows: Column) -> Column:
    """Markdown of a table: header, dashes, rows."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    dashes = line(F.transform(header, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(header), dashes), F.transform(rows, line)), "\n")


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """State of each manifest row (filename, sha256): missing, unrecorded, ok or mismatch. files: filename, content."""
    have = files.select("filename", F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.coalesce(F.length("sha256"), F.lit(0)) == 0, "unrecorded").when(F.col("found") == F.col("sha256"), "ok").otherwise("mismatch")
    return manifest.join(have, "filename", "left").withColumn("state", state)


def read_eval_cases(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(name, case_id, query, kind, gold, …): evaluation datasets in JSON, one row for each case."""
    return spark.read.option("multiLine", True).json(path).select("name", F.explode("cases").alias("c")).select("name", "c.*")


def write_eval_cases(cases: DataFrame, path: str) -> None:
    cases.groupBy("name").agg(F.collect_list(F.struct(*[c for c in cases.columns if c != "name"])).alias("cases")).write.mode("overwrite").json(path)
