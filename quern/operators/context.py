"""Context processing: curation, compression, order; extractive answers, citations, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SNIPPET_CHARS, blank_tokens, compressor_sentences, count_tokens, jaccard, snippet, word_set

#: Prefixes of the ids of local models, which are free, as are ids with a slash (fixed).
FREE = ("hash-emb", "bm25-local", "extractive", "identity-rerank", "mmr-rerank", "fake-")


def curate(contexts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Drop a context whose token set is at least `threshold` similar (Jaccard) to one that was kept before it.

    contexts: query_id, position, text and more columns. The fold runs over
    one query's positions and token sets; texts are joined back.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = contexts.select("query_id", "position", F.array_distinct(blank_tokens(F.lower(F.col("text")))).alias("s"))
    listed = sets.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "s"))).alias("l"))
    empty = F.array().cast("array<struct<position:int,s:array<string>>>")
    keep = F.aggregate(
        F.transform("l", lambda e: F.struct(e["position"].cast("int").alias("position"), e["s"].alias("s"))), empty,
        lambda acc, x: F.when(F.exists(acc, lambda k: jaccard(k["s"], x["s"]) >= threshold), acc).otherwise(F.concat(acc, F.array(x))),
    )
    kept = listed.select("query_id", F.explode(F.transform(keep, lambda k: k["position"])).alias("position"))
    return contexts.join(kept, ["query_id", "position"], "left_semi")


def compress(contexts: DataFrame, query: str = "query", min_keep: int = 1) -> DataFrame:
    """Keep sentences that cover more of the query's words than the chunk's mean; at least min_keep, the best first."""
    if min_keep < 1:
        raise ValueError("min_keep must be at least 1")
    q = word_set(F.col(query))
    score = lambda s: F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, word_set(s))) / F.size(q))
    scored = F.transform(compressor_sentences(F.col("text")), lambda s, i: F.struct((-score(s)).alias("minus"), i.alias("i"), s.alias("s")))
    rows = contexts.withColumn("__s", scored)
    mean = F.aggregate("__s", F.lit(0.0), lambda a, e: a - e["minus"]) / F.greatest(F.size("__s"), F.lit(1))
    above = F.filter("__s", lambda e: -e["minus"] > mean + 1e-12)
    best = F.slice(F.array_sort("__s"), 1, min_keep)
    chosen = F.when(F.size(above) >= min_keep, above).otherwise(best)
    back = F.transform(F.array_sort(F.transform(chosen, lambda e: F.struct(e["i"].alias("i"), e["s"].alias("s")))), lambda e: e["s"])
    text = F.when(F.size("__s") <= 1, F.col("text")).otherwise(F.array_join(back, " "))
    return rows.withColumn("text", text).withColumn("token_count", count_tokens(F.col("text"))).drop("__s")


def outward(position: Column, n: Column) -> Column:
    """New 0-based place of 1-based positions: 1, 3, 5 … from the front, 2, 4, 6 … from the back."""
    return F.when(position % 2 == 1, (position - 1) / 2).otherwise(n - position / 2).cast("int")


def reorder(contexts: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("query_id"))
    return contexts.withColumn("position", outward(F.col("position"), n) + 1)


def renumber(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))


def process(contexts: DataFrame, query: str = "query") -> DataFrame:
    """Curate, compress, reorder."""
    return reorder(compress(renumber(curate(contexts)), query))


def extractive_answers(queries: DataFrame, contexts: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, answer, citations): numbered snippets of the first contexts, one citation each; none: an empty answer.

    contexts: query_id, position, chunk_id, document_id, text, page_span, section_path.
    """
    cited = contexts.where(F.col("position") <= most).select(
        "query_id", F.struct("position", "chunk_id", "document_id", snippet(F.col("text")).alias("snippet"), F.lit(0.0).alias("score"), "page_span", "section_path").alias("c")
    )
    grouped = cited.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("citations"))
    joined = queries.join(grouped, "query_id", "left")
    lines = F.transform("citations", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["snippet"]))
    head = F.concat(F.lit("Based on "), F.size("citations").cast("string"), F.lit(" retrieved passage(s):\n"))
    text = F.when(F.size("citations") > 0, F.concat(head, F.array_join(lines, "\n"))).otherwise("")
    return joined.select("query_id", F.coalesce(text, F.lit("")).alias("answer"), F.coalesce("citations", F.array()).alias("citations"))


def cited_contexts(queries: DataFrame, contexts: DataFrame, most_chars: int = SNIPPET_CHARS) -> DataFrame:
    """(query_id, answer, citations) for a model to answer: an empty answer and one citation for each context, with the beginning of its text as it is."""
    cited = contexts.select(
        "query_id", F.struct("position", "chunk_id", "document_id", F.substring("text", 1, most_chars).alias("snippet"), F.lit(0.0).alias("score"), "page_span", "section_path").alias("c")
    )
    grouped = cited.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("citations"))
    return queries.join(grouped, "query_id", "left").select("query_id", F.lit("").alias("answer"), F.coalesce("citations", F.array()).alias("citations"))


def unresolved_citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Citations that name no context: must be empty."""
    said = answers.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.chunk_id")
    return said.join(contexts, ["query_id", "chunk_id"], "left_anti")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """estimated_cost_usd of rows (model_id, input_chars, output_chars) at four characters a token: longest price prefix, free and unknown models 0."""
    priced = usage.withColumn("__row", F.monotonically_increasing_id()).join(prices, F.startswith(F.col("model_id"), F.col("prefix")), "left")
    best = priced.groupBy(*usage.columns, "__row").agg(F.max_by(F.struct("usd_in", "usd_out"), F.length("prefix")).alias("p"))
    tokens = lambda c: F.col(c) / 4
    free = F.array_contains(F.transform(F.array(*map(F.lit, FREE)), lambda p: F.startswith(F.col("model_id"), p)), True) | F.contains(F.col("model_id"), F.lit("/"))
    usd = (tokens("input_chars") * F.col("p.usd_in") + tokens("output_chars") * F.col("p.usd_out")) / 1e6
    return best.withColumn("estimated_cost_usd", F.when(free, 0.0).otherwise(F.coalesce(usd, F.lit(0.0)))).drop("p", "__row")
