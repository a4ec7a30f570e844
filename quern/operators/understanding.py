"""Query understanding: expansion, decomposition, routing, grading, follow-up, contexts. Expressions over query texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, count_tokens, jaccard, word_set, words

#: Connectives (fixed).
ENGLISH_JOINTS = r"(?i)\s+(?:and|or|versus|vs\.?)\s+|[;,]\s*"
KOREAN_JOINTS = r"\s*(?:그리고|또는|및|이랑|랑)\s*"
#: Substrings that mark a query of several steps (fixed).
CUES = [
    "compare", "comparison", "difference between", "differences between", "relationship", "relation between", "how does", "how do", "both",
    "and how", "versus", "vs.", "vs ", "contrast", "similarities", "similarity between", "distinguish", "while also", "as well as",
]
#: A query of nothing but arithmetic, and the least length of a sub-question's subject (fixed).
ARITHMETIC = r"^[\d\s\+\-\*\/\^\(\)\.%±×÷]+$"
#: Question forms of the decomposer (fixed), in order of precedence.
COMPARED = r"(?i)^\s*(?:compare|comparison of|difference between|differences between)\s+(.+?)\s+(?:with|and|vs\.?|versus)\s+(.+?)\s*\??\s*$"
CAUSED = r"(?i)^\s*(?:how does|how do|what is the effect of|what are the effects of)\s+(.+?)\s+(?:affect|affect\s+the|on|impact)\s+(.+?)\s*\??\s*$"
BOTH = r"(?i)\bboth\s+(.+?)\s+and\s+(.+?)(?:\s*\?|$)"
TWO = r"(?i)^(.+?)\s+(?:and also|as well as|and)\s+(.+?)\s*\??\s*$"
COMMA = r"(?i)^(.+?)\s*,\s*and\s+(.+?)\s*\??\s*$"
ASKS = r"(?i)^\s*(?:what|where|when|who|how|why|which|is|are|does|do)\b"
VERB = r"(?i)\b(?:is|are|was|were|be|been|being|have|has|had|do|does|did|will|would|can|could|should|shall|may|might|must|located|found|known|called|named|used|made|built|situated)\b"
LEAST_CLAUSE = 5


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def expand(query: Column, least: int = 3) -> Column:
    """The query and its clauses of `least` characters or more, each once."""
    text = strip(query)
    parts = F.flatten(F.transform(F.split(text, ENGLISH_JOINTS), lambda p: F.split(p, KOREAN_JOINTS)))
    clauses = F.when(F.size(parts) > 1, F.filter(F.transform(parts, strip), lambda p: F.length(p) >= least)).otherwise(F.array().cast("array<string>"))
    return F.when(text == "", F.array(query)).otherwise(F.array_distinct(F.concat(F.array(text), clauses)))


def _ended(c: Column) -> Column:
    body = strip(F.regexp_replace(strip(c), r"\?+$", ""))
    return F.when(body == "", body).otherwise(F.concat(body, F.lit("?")))


def _noun(c: Column) -> Column:
    body = F.regexp_replace(strip(c), r"\?+$", "")
    return F.when(body.rlike(ASKS), _ended(body)).otherwise(F.concat(F.lit("What is "), body, F.lit("?")))


def decompose(query: Column) -> Column:
    """Sub-questions by the first form that fits and whose clauses are long enough; else the query itself."""
    text = strip(query)

    def form(pattern: str) -> tuple[Column, Column, Column]:
        x, y = (strip(F.regexp_extract(text, pattern, i)) for i in (1, 2))
        return (F.length(x) >= LEAST_CLAUSE) & (F.length(y) >= LEAST_CLAUSE), x, y

    (c, cx, cy), (e, ex, _), (b, bx, by), (t, tx, ty), (m, mx, my) = map(form, (COMPARED, CAUSED, BOTH, TWO, COMMA))
    return (
        F.when(text == "", F.array(query))
        .when(c, F.array(_noun(cx), _noun(cy)))
        .when(e, F.array(_noun(ex), _ended(text)))
        .when(b, F.array(_noun(bx), _noun(by)))
        .when(t, F.when(ty.rlike(VERB), F.array(_ended(tx), _ended(ty))).otherwise(F.array(_noun(tx), _noun(ty))))
        .when(m, F.array(_ended(mx), _ended(my)))
        .otherwise(F.array(query))
    )


def route(query: Column, cues: list[str] | None = None, most_tokens: int = 4) -> Column:
    """multi_step if a cue is a substring; no_retrieval if short or arithmetic; else single_step."""
    text = F.lower(strip(query))
    hit = F.exists(F.array(*[F.lit(c) for c in (cues or CUES)]), lambda c: F.contains(text, c))
    return F.when(hit, "multi_step").when((count_tokens(text) <= most_tokens) | text.rlike(ARITHMETIC), "no_retrieval").otherwise("single_step")


def grade(queries: DataFrame, hits: DataFrame, least_score: float = 0.0, least_overlap: float = 0.1) -> DataFrame:
    """(query_id, grade) from the first hit: incorrect without one or below least_score; correct by word overlap; else ambiguous."""
    top = hits.where("rank = 1").select("query_id", "score", "text")
    both = queries.join(top, "query_id", "left")
    overlap = jaccard(word_set(F.col("query")), word_set(F.coalesce("text", F.lit(""))))
    g = F.when(F.col("score").isNull() | (F.col("score") < least_score), "incorrect").when((F.trim(F.coalesce("text", F.lit(""))) != "") & (overlap >= least_overlap), "correct").otherwise("ambiguous")
    return both.select("query_id", g.alias("grade"))


def coverage(query: Column, seen: Column, least_chars: int = 2) -> Column:
    """Share of the query's words that are among the seen words; no words: null."""
    q = F.filter(word_set(query), lambda w: F.length(w) >= least_chars)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, seen)) / F.size(q))


def follow_up(state: DataFrame, found: DataFrame, round_index: int, max_hops: int = 3, least_coverage: float = 0.85, terms: int = 6, least_chars: int = 2) -> DataFrame:
    """(query_id, next_query, bridge): what to ask next, for queries that go on.

    state: query_id, query, vocabulary (words asked so far). found: query_id,
    chunk_id, text, hop of all accumulated chunks. New words of the chunks
    that came in this round are counted by chunk; the most frequent ones, then
    the alphabetically first, are added to the query.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    if round_index >= max_hops - 1:
        return state.sparkSession.createDataFrame([], f"query_id {state.schema['query_id'].dataType.simpleString()}, next_query string, bridge array<string>")
    seen = found.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(word_set(F.col("text"))))).alias("seen"))
    on = state.join(seen, "query_id").where(F.coalesce(coverage(F.col("query"), F.col("seen"), least_chars), F.lit(0.0)) < least_coverage)
    fresh = found.where(F.col("hop") == round_index).select("query_id", F.explode(word_set(F.col("text"))).alias("t")).where(F.length("t") >= least_chars)
    known = state.select("query_id", F.explode("vocabulary").alias("t"))
    counts = fresh.join(known, ["query_id", "t"], "left_anti").groupBy("query_id", "t").agg(F.count("*").alias("df"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("df"), "t"))).where(F.col("r") <= terms)
    bridge = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda e: e["t"]).alias("bridge"))
    return on.join(bridge, "query_id").select("query_id", F.concat_ws(" ", "query", F.array_join("bridge", " ")).alias("next_query"), "bridge")


def situate(title: Column, path: Column) -> Column:
    """Context of a chunk: title and breadcrumbs, each once."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(F.coalesce(title, F.lit(""))), path), lambda p: p != "")), " › ")


def hypothetical(query: Column, llm: Callable[[Column], Column]) -> Column:
    """The query and the passage that a caller's column function writes for it, each once and without blanks at its ends; of an empty query the passage, if any."""
    text, said = strip(query), strip(F.coalesce(llm(strip(query)), F.lit("")))
    both = F.array_distinct(F.filter(F.array(text, said), lambda t: t != ""))
    return F.when(F.size(both) > 0, both).otherwise(F.array(query))


def vocabulary(query: Column) -> Column:
    return F.array_distinct(words(query))
