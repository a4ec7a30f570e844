"""Chunking: elements to chunks. Elements: document_id, source_id, ord, type, text, section_path, element_id, start_page, end_page."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.lazy import column_function
from ..functions.text import BLANK, SENTENCE_END, blank_tokens, count_tokens, sentences, stable_id, words
from ..functions.vectors import DENSE_DIM, hash_bucket, hash_sign

VERSION = "1.0.0"


def section_key(kind: Column, text: Column, path: Column) -> Column:
    """Breadcrumb of a section: a title opens the one named by itself."""
    return F.when(kind == "Title", F.concat(path, F.array(text))).otherwise(path)


def sections(elements: DataFrame) -> DataFrame:
    """(document_id, source_id, section_ord, section_path, text, parts): runs of elements of one key.

    text joins element texts by blank lines; parts holds each element's id,
    half-open range in it and pages.
    """
    by_doc = Window.partitionBy("document_id").orderBy("ord")
    key = elements.withColumn("key", section_key(F.col("type"), F.col("text"), F.col("section_path")))
    flag = key.withColumn("new", F.when(F.lag("ord").over(by_doc).isNull() | (F.lag("key").over(by_doc) != F.col("key")), 1).otherwise(0))
    island = flag.withColumn("section_ord", F.sum("new").over(by_doc) - 1)
    run = Window.partitionBy("document_id", "section_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = island.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(run), F.lit(0)).cast("int"))
    part = F.struct("ord", "element_id", "text", "start", (F.col("start") + F.length("text")).cast("int").alias("end"), "start_page", "end_page")
    grouped = placed.groupBy("document_id", "source_id", "section_ord").agg(F.first("key").alias("section_path"), F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"))


def attribute(parts: Column, start: Column, end: Column) -> Column:
    """Parts that overlap [start, end), all parts if none does."""
    hit = F.filter(parts, lambda p: (p["start"] < end) & (start < p["end"]))
    return F.when(F.size(hit) == 0, parts).otherwise(hit)


def _finish(rows: DataFrame, strategy: str) -> DataFrame:
    """Chunks of rows; those that have `hit`, the parts they overlap, and token_count already keep them."""
    if "hit" not in rows.columns:
        rows = rows.withColumns({"hit": attribute(F.col("parts"), F.col("char_start"), F.col("char_end")), "token_count": count_tokens(F.col("text"))})
    return rows.select(
        "chunk_id", "document_id", "source_id", "text",
        F.struct(F.array_min(F.transform("hit", lambda p: p["start_page"])).alias("start_page"), F.array_max(F.transform("hit", lambda p: p["end_page"])).alias("end_page")).alias("page_span"),
        "section_path", F.transform("hit", lambda p: p["element_id"]).alias("element_ids"), "char_start", "char_end",
        "token_count", F.lit(strategy).alias("chunk_strategy"), F.lit(VERSION).alias("chunk_version"),
        F.lit(None).cast("string").alias("parent_chunk_id"), "context", "section_ord", "chunk_ord",
    )


#: Characters of windows that a task gathers before it hands them on.
CHARS_AT_ONCE = 1 << 21


def token_bounds(text: str, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens between white space begin and end; blank: whether a character below U+3001 is white space, and at last False for all others."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = np.zeros(len(codes) + 2, np.int8)
    solid[1:-1] = ~blank[np.minimum(codes, len(blank) - 1)]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def token_windows(found: DataFrame, max_tokens: int, step: int) -> DataFrame:
    """(document_id, section_ord, source_id, section_path, window, char_start, char_end, token_count, text, hit) of sections(); hit: the parts that a window overlaps.

    A window's row holds its own text and parts only, never the section's, and a
    task holds the windows of some texts: memory and work follow the length of
    the texts, also of one long text.
    """
    part = lambda p: F.struct(F.length(p["text"]).alias("length"), *(p[c].alias(c) for c in ("element_id", "start_page", "end_page")))
    parts = F.transform(F.filter("parts", lambda p: p["text"].isNotNull()), part)
    rows = found.select(*SECTION, "source_id", "section_path", "text", parts.alias("hit"))
    kept = [*SECTION, "source_id", "section_path"]
    numbers = ["window", "char_start", "char_end", "token_count"]
    kind = StructType([*(rows.schema[c] for c in kept), *(StructField(c, IntegerType()) for c in numbers), StructField("text", StringType()), rows.schema["hit"]])
    arrow = to_arrow_schema(kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = np.array([chr(c).isspace() for c in range(0x3002)])
        for batch in batches:
            texts, listed = batch.column(4), batch.column(5)
            offsets, flat = listed.offsets.to_numpy(), listed.values
            lengths = flat.field(0).to_numpy(zero_copy_only=False)
            own, cuts, text, near, chars = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                at, bounds = pa.array(np.array(own, np.int64)), np.concatenate(cuts).T.astype(np.int32)
                low, high = np.concatenate(near).T
                sizes = high - low
                places = np.concatenate([[0], np.cumsum(sizes)])
                picked = np.repeat(low - places[:-1], sizes) + np.arange(places[-1])
                hit = pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat.take(pa.array(picked)))
                columns = [*(batch.column(i).take(at) for i in range(4)), *map(pa.array, bounds), pa.array(text, pa.string()), hit]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

            for i in range(batch.num_rows):
                whole = texts[i].as_py()
                if whole is None:
                    continue
                begin, end = token_bounds(whole, blank)
                if not len(begin):
                    continue
                n = 1 if len(begin) <= max_tokens else -(-(len(begin) - max_tokens) // step) + 1
                first = np.arange(n) * step
                last = np.minimum(first + max_tokens, len(begin))
                s, e = begin[first], end[last - 1]
                a, b = offsets[i], offsets[i + 1]
                ends = np.cumsum(lengths[a:b] + 2, dtype=np.int64) - 2
                low, high = np.searchsorted(ends, s, "right") + a, np.searchsorted(ends - lengths[a:b], e, "left") + a
                for x in range(0, n, 1024):
                    run = slice(x, x + 1024)
                    text += [whole[p:q] for p, q in zip(s[run].tolist(), e[run].tolist(), strict=True)]
                    own += [i] * len(s[run])
                    cuts.append(np.stack([np.arange(n)[run], s[run], e[run], (last - first)[run]], axis=1))
                    near.append(np.stack([low[run], high[run]], axis=1))
                    chars += int((e[run] - s[run]).sum())
                    if chars >= CHARS_AT_ONCE:
                        yield made()
                        own, cuts, text, near, chars = [], [], [], [], 0
            if own:
                yield made()

    return rows.mapInArrow(cut, kind)


def heading_aware(elements: DataFrame, max_tokens: int = 180, overlap_tokens: int = 40) -> DataFrame:
    """Windows of max_tokens tokens that overlap, inside each section; the text is the exact substring."""
    if overlap_tokens >= max_tokens:
        raise ValueError("overlap must be less than max_tokens")
    cut = token_windows(sections(elements), max_tokens, max_tokens - overlap_tokens)
    cut = cut.withColumn("chunk_id", stable_id(F.col("document_id"), F.lit("heading_aware"), F.lit(VERSION), F.array_join("section_path", "/"), F.col("window"), F.col("char_start")))
    return _finish(cut.withColumns({"context": F.lit(None).cast("string"), "chunk_ord": F.col("window")}), "heading_aware")


SECTION = ["document_id", "section_ord"]


def sentence_rows(found: DataFrame) -> DataFrame:
    """(document_id, section_ord, pos, text, char_start, char_end): stripped sentences of sections() and their ranges, pos without gaps.

    Sentences and what parts them are cut by one pattern, so their lengths add
    up to the ranges. Only the sentences travel, by section, not the section
    with each of them.
    """
    cut = found.select(*SECTION, F.posexplode(F.arrays_zip(F.split("text", SENTENCE_END).alias("piece"), F.regexp_extract_all("text", F.lit(SENTENCE_END), F.lit(0)).alias("gap"))).alias("at", "x"))
    before = Window.partitionBy(*SECTION).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.col("x.piece")
    lead = F.length(piece) - F.length(F.regexp_replace(piece, f"^{BLANK}+", ""))
    start = F.coalesce(F.sum(F.length(piece) + F.coalesce(F.length("x.gap"), F.lit(0))).over(before), F.lit(0)) + lead
    body = F.regexp_replace(piece, f"^{BLANK}+|{BLANK}+$", "")
    rows = cut.select(*SECTION, "at", body.alias("text"), start.cast("int").alias("char_start")).where("text <> ''")
    pos = F.row_number().over(Window.partitionBy(*SECTION).orderBy("at")) - 1
    return rows.select(*SECTION, pos.alias("pos"), "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))


def _of_sections(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their section's source, path, text and parts; of the parts only what _finish() reads."""
    part = lambda p: F.struct(*(p[c].alias(c) for c in ("element_id", "start", "end", "start_page", "end_page")))
    return rows.join(found.select(*SECTION, "source_id", "section_path", F.col("text").alias("section"), F.transform("parts", part).alias("parts")), SECTION)


def propositions(elements: DataFrame, skip_single_word: bool = True) -> DataFrame:
    """One sentence, one chunk; its context is the section's path. The index counts skipped sentences too."""
    found = sections(elements)
    rows = sentence_rows(found)
    if skip_single_word:
        rows = rows.where(count_tokens(F.col("text")) > 1)
    rows = _of_sections(rows, found).withColumns({"chunk_ord": F.col("pos"), "context": F.when(F.size("section_path") > 0, F.array_join("section_path", " > "))})
    rows = rows.withColumn("chunk_id", stable_id(F.col("document_id"), F.lit("proposition"), F.lit(VERSION), F.array_join("section_path", "/"), F.col("pos"), F.col("char_start")))
    return _finish(rows, "proposition")


def neighbour_gaps(sents: DataFrame, dim: int = DENSE_DIM) -> DataFrame:
    """(document_id, section_ord, pos, gap): cosine distance of each sentence's hashed embedding from the one before, 1 where either has no words.

    Coordinates are counted as whole numbers; a coordinate's neighbour is the
    row before it in the window of its bucket, so no vector is built.
    """
    tokens = sents.select(*SECTION, "pos", F.explode(words(F.col("text"))).alias("t"))
    counts = tokens.groupBy(*SECTION, "pos", hash_bucket(F.col("t"), dim).alias("bucket")).agg(F.sum(hash_sign(F.col("t")).cast("long")).alias("v"))
    by_bucket = Window.partitionBy(*SECTION, "bucket").orderBy("pos")
    met = F.when(F.lag("pos").over(by_bucket) == F.col("pos") - 1, F.lag("v").over(by_bucket) * F.col("v")).otherwise(0)
    sums = counts.withColumn("met", met).groupBy(*SECTION, "pos").agg(F.sum("met").alias("dot"), F.sum(F.col("v") * F.col("v")).alias("size"))
    order = Window.partitionBy(*SECTION).orderBy("pos")
    all_rows = sents.select(*SECTION, "pos").join(sums, [*SECTION, "pos"], "left").withColumn("before", F.lag("size").over(order))
    scale = F.sqrt((F.col("size") * F.col("before")).cast("double"))
    return all_rows.where("pos > 0").select(*SECTION, "pos", (1.0 - F.when(scale > 0, F.col("dot") / scale).otherwise(0.0)).alias("gap"))


def semantic(elements: DataFrame, percentile: float = 90.0, max_tokens: int = 180) -> DataFrame:
    """Sentences of a section, cut where neighbours are farther apart than the percentile of all distances, or the token budget ends.

    The percentile is exact, with linear interpolation. Cuts at distances part a
    section into runs that the budget can't reach across; the budget is kept by
    a fold over the sentences of such a run. All windows and groups share the
    exchange by section.
    """
    if not 0 < percentile < 100:
        raise ValueError("percentile must be between 0 and 100")
    found = sections(elements)
    sents = sentence_rows(found).withColumn("tokens", count_tokens(F.col("text")))
    gaps = neighbour_gaps(sents)
    limits = gaps.groupBy(*SECTION).agg(F.percentile("gap", percentile / 100).alias("limit"))
    order = Window.partitionBy(*SECTION).orderBy("pos")
    far = F.coalesce(F.col("gap") > F.col("limit"), F.lit(False))
    placed = sents.join(gaps, [*SECTION, "pos"], "left").join(limits, SECTION, "left").withColumn("run", F.sum(far.cast("int")).over(order))
    runs = placed.groupBy(*SECTION, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens", "char_start", "char_end"))).alias("l"))
    # at: index of the sentence, held: tokens of the open chunk, starts: where chunks begin
    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, x: Column) -> Column:
        cut = (state["at"] == 0) | (state["held"] + x["tokens"] > max_tokens)
        return F.struct(
            (state["at"] + 1).alias("at"), (F.when(cut, 0).otherwise(state["held"]) + x["tokens"]).alias("held"),
            F.when(cut, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"),
        )

    folded = runs.withColumn("starts", F.aggregate("l", nothing, step)["starts"])
    last = lambda i: F.coalesce(F.get("starts", i + 1), F.size("l")) - 1
    ranges = F.transform("starts", lambda s, i: F.struct(F.get("l", s)["char_start"].alias("char_start"), F.get("l", last(i))["char_end"].alias("char_end")))
    rows = folded.select(*SECTION, F.explode(ranges).alias("c")).select(*SECTION, "c.*")
    rows = rows.withColumn("chunk_ord", F.row_number().over(Window.partitionBy(*SECTION).orderBy("char_start")) - 1)
    rows = _of_sections(rows, found).withColumns({"context": F.lit(None).cast("string"), "text": F.substring("section", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))})
    rows = rows.withColumn("chunk_id", stable_id(F.col("document_id"), F.lit("semantic"), F.lit(VERSION), F.array_join("section_path", "/"), F.col("chunk_ord"), F.col("char_start")))
    return _finish(rows, "semantic")


@lru_cache(maxsize=1 << 16)
def _hashed_token(token: str) -> tuple[int, float]:
    d = hashlib.sha1(token.encode()).digest()
    return int.from_bytes(d[:4], "big"), 1.0 if d[4] & 1 else -1.0


def hashed(text: str, dim: int = 256) -> dict[int, float]:
    """Unit vector of one text as the hash embedding gives it, for the sequential chunkers."""
    found: dict[int, float] = {}
    for token in re.findall(r"\w+", text.lower()):
        bucket, sign = _hashed_token(token)
        bucket %= dim
        found[bucket] = found.get(bucket, 0.0) + sign
    size = math.sqrt(sum(v * v for v in found.values()))
    return {b: v / size for b, v in found.items() if v} if size else {}


def _cos(a: dict[int, float], b: dict[int, float]) -> float:
    na, nb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
    return sum(v * b.get(k, 0.0) for k, v in a.items()) / (na * nb) if na and nb else 0.0


def clusters(vectors: list[dict[int, float]], threshold: float) -> list[int]:
    """Cluster of each vector: the nearest running mean above threshold, else a new one; in input order. Cosines are compared by 12 decimals."""
    dim = 1 + max((k for v in vectors for k in v), default=0)
    means, norms, sizes = np.zeros((16, dim)), np.zeros(16), []
    out = []
    for v in vectors:
        x = np.zeros(dim)
        x[list(v)] = list(v.values())
        n = len(sizes)
        both = norms[:n] * math.sqrt(x @ x)
        sims = np.round(np.divide(means[:n] @ x, both, out=np.zeros(n), where=both > 0), 12)
        best = int(sims.argmax()) if n else -1
        if best < 0 or sims[best] <= threshold:
            best = n
            sizes.append(0)
            if n == len(means):
                means, norms = np.concatenate([means, np.zeros_like(means)]), np.concatenate([norms, np.zeros_like(norms)])
        sizes[best] += 1
        means[best] += (x - means[best]) / sizes[best]
        norms[best] = math.sqrt(means[best] @ means[best])
        out.append(best)
    return out


@column_function("array<int>")
def _labels(texts: pd.Series, threshold: pd.Series) -> pd.Series:
    return pd.Series([clusters([hashed(t) for t in ts], x) for ts, x in zip(texts, threshold, strict=True)])


def common_path(paths: Column) -> Column:
    """Longest common prefix of paths; the first path if they share none."""
    first = F.element_at(paths, 1)
    same = F.filter(F.sequence(F.lit(0), F.size(first)), lambda n: F.forall(paths, lambda p: F.slice(p, 1, n) == F.slice(first, 1, n)))
    return F.when(F.array_max(same) == 0, first).otherwise(F.slice(first, 1, F.array_max(same)))


def hierarchical(leaves: DataFrame, threshold: float = 0.5, summary_max_tokens: int = 120) -> DataFrame:
    """Parents over clusters of a document's leaves, and the leaves under them.

    A parent's text is the first sentence of each of its leaves, cut to
    summary_max_tokens words; its path is the longest common prefix. A single
    leaf has no parent. Only the labels are found sequentially, within one
    document; parents are groups of labels.
    """
    in_doc = Window.partitionBy("document_id").orderBy("section_ord", "chunk_ord")
    kids = leaves.withColumns({"at": F.row_number().over(in_doc) - 1, "n": F.count("*").over(Window.partitionBy("document_id"))}).withColumns({
        "chunk_id": stable_id(F.col("chunk_id"), F.lit("hierarchical"), F.lit("leaf")), "chunk_strategy": F.lit("hierarchical"), "chunk_version": F.lit(VERSION),
    })
    listed = kids.where("n > 1").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda e: e["text"]).alias("texts"))
    labels = listed.select("document_id", F.posexplode(_labels("texts", F.lit(threshold))).alias("at", "label"))
    parent = stable_id(F.col("document_id"), F.lit("hierarchical"), F.lit(VERSION), F.lit("parent"), F.col("label"))
    named = kids.join(labels, ["document_id", "at"], "left").withColumn("parent_chunk_id", F.when(F.col("label").isNotNull(), parent))
    lead = F.coalesce(F.try_element_at(sentences(F.col("text")), F.lit(1)), F.trim("text"))
    member = F.struct("at", lead.alias("lead"), "section_path", "element_ids", "page_span")
    groups = named.where("label is not null").groupBy("document_id", "parent_chunk_id").agg(F.array_sort(F.collect_list(member)).alias("own"), F.min_by(F.struct("source_id", "context", "section_ord", "chunk_ord"), "at").alias("first"))
    tokens = blank_tokens(F.array_join(F.transform("own", lambda m: m["lead"]), " "))
    whole = F.array_join(F.transform("own", lambda m: m["lead"]), " ")
    tops = groups.withColumn("text", F.when(F.size(tokens) > summary_max_tokens, F.array_join(F.slice(tokens, 1, summary_max_tokens), " ")).otherwise(whole))
    tops = tops.select(
        F.col("parent_chunk_id").alias("chunk_id"), "document_id", "first.*", "text", common_path(F.transform("own", lambda m: m["section_path"])).alias("section_path"),
        F.lit(0).alias("char_start"), F.length("text").alias("char_end"), count_tokens(F.col("text")).alias("token_count"),
        F.lit("hierarchical").alias("chunk_strategy"), F.lit(VERSION).alias("chunk_version"), F.lit(None).cast("string").alias("parent_chunk_id"),
        F.array_distinct(F.flatten(F.transform("own", lambda m: m["element_ids"]))).alias("element_ids"),
        F.struct(F.array_min(F.transform("own", lambda m: m["page_span"]["start_page"])).alias("start_page"), F.array_max(F.transform("own", lambda m: m["page_span"]["end_page"])).alias("end_page")).alias("page_span"),
    )
    return named.select(leaves.columns).unionByName(tops.select(leaves.columns))
