"""Retrieval, answer, grounding and parsing metrics. One row of results for each case."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lazy import column_function
from ..functions.text import containment, metric_sentences, word_set, words
from ..functions.vectors import cosine

#: Phrases of answers that abstain (fixed).
HEDGES = (
    r"(?iu)(?:\b(?:i don'?t know|i do not know|cannot determine|can'?t determine|not enough information|don'?t have enough|do not have enough"
    r"|insufficient(?:\s+(?:context|information))?|unable to (?:answer|determine|find)|no information|unclear from|not specified|no relevant|cannot answer|can'?t answer)\b"
    r"|모르겠|알 수 없|정보가 없|확인할 수 없)"
)
KOREAN_UNITS = {"조": 10**12, "억": 10**8, "만": 10**4}


def ranking_metrics(hits: DataFrame, gold: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """(case_id, recall, mrr, ndcg, context_precision) of hits (case_id, rank, chunk_id) and gold (case_id, chunk_id, relevance).

    Cases without gold or without hits score 0.
    """
    g = gold.withColumn("ideal_rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("relevance"), "chunk_id")))
    ideal = g.groupBy("case_id").agg(F.count("*").alias("n_gold"), F.sum(F.when(F.col("ideal_rank") <= k, F.col("relevance") / F.log2(F.col("ideal_rank") + 1.0))).alias("idcg"))
    met = hits.join(gold, ["case_id", "chunk_id"])
    order = Window.partitionBy("case_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("so_far", F.count("*").over(order))
    inside = F.col("rank") <= k
    agg = met.groupBy("case_id").agg(
        F.count_distinct(F.when(inside, F.col("chunk_id"))).alias("n_hit"), F.min("rank").alias("first"),
        F.sum(F.when(inside, F.col("relevance") / F.log2(F.col("rank") + 1.0))).alias("dcg"), F.sum(F.when(inside, F.col("so_far") / F.col("rank"))).alias("ap"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.select("case_id").join(ideal, "case_id", "left").join(agg, "case_id", "left").select(
        "case_id", zero(F.col("n_hit") / F.col("n_gold")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"), zero(F.col("ap") / F.least("n_gold", F.lit(k))).alias("context_precision"),
    )


def citation_faithfulness(cited: Column, retrieved: Column) -> Column:
    """Share of cited ids that were retrieved; none cited: 1."""
    return F.when(F.size(cited) == 0, 1.0).otherwise(F.size(F.filter(cited, lambda c: F.array_contains(retrieved, c))) / F.size(cited))


def numeric_accuracy(answer: Column, expected: Column, tolerance: float = 0.001) -> Column:
    """1 within tolerance * max(|expected|, 1); null answer: 0."""
    return F.when(answer.isNull(), 0.0).when(F.abs(answer - expected) <= tolerance * F.greatest(F.abs(expected), F.lit(1.0)), 1.0).otherwise(0.0)


def share(values: Column, test) -> Column:  # noqa: ANN001
    return F.size(F.filter(values, test)) / F.size(values)


def grounded(text: Column, source_words: Column, threshold: float = 0.6) -> Column:
    """Share of the text's sentences whose words are at least `threshold` contained in the source words."""
    return share(metric_sentences(text), lambda s: containment(word_set(s), source_words) >= threshold)


def faithfulness(answer: Column, contexts: Column, threshold: float = 0.6) -> Column:
    """No sentence: 1; no context: 0."""
    union = F.array_distinct(F.flatten(F.transform(contexts, word_set)))
    return F.when(F.size(metric_sentences(answer)) == 0, 1.0).when(F.size(contexts) == 0, 0.0).otherwise(grounded(answer, union, threshold))


claim_precision = faithfulness


def claim_recall(answer: Column, gold: Column, threshold: float = 0.6) -> Column:
    """Share of gold sentences that the answer holds; empty gold: 1; empty answer: 0."""
    return F.when(F.size(metric_sentences(gold)) == 0, 1.0).when(F.size(words(answer)) == 0, 0.0).otherwise(grounded(gold, word_set(answer), threshold))


def answer_relevance(answer_vec: Column, query_vec: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(answer_vec, query_vec)))


def answer_correctness(answer: Column, reference: Column) -> Column:
    """F1 of word multisets; both empty: 1; one empty: 0."""
    a, r = words(answer), words(reference)
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(r, w)))
    return F.when((F.size(a) == 0) & (F.size(r) == 0), 1.0).when(same == 0, 0.0).otherwise(2.0 * same / (F.size(a) + F.size(r)))


def noise_sensitivity(answer: Column, contexts: Column, gold: Column, threshold: float = 0.6) -> Column:
    """Share of claims that gold does not hold but a context does that gold does not hold either."""
    g = word_set(gold)
    noisy = F.filter(F.transform(contexts, word_set), lambda c: (F.size(c) > 0) & (containment(c, g) < threshold))
    bad = lambda s: (containment(word_set(s), g) < threshold) & F.exists(noisy, lambda c: containment(word_set(s), c) >= threshold)
    claims = metric_sentences(answer)
    return F.when(F.size(claims) == 0, 0.0).otherwise(share(claims, bad))


def support(sentence: Column, cited: Column) -> Column:
    """Best of 1, 0.5 and 0 over the cited texts, at containments of 0.8 and 0.4."""
    s = word_set(sentence)
    grade = lambda t: F.when(containment(s, word_set(t)) >= 0.8, 1.0).when(containment(s, word_set(t)) >= 0.4, 0.5).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(cited, grade)), F.lit(0.0))


def citation_precision(pairs: Column) -> Column:
    """Mean support of pairs array<struct<sentence, cited array<string>>>; none: 1."""
    return F.when(F.size(pairs) == 0, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + support(p["sentence"], p["cited"])) / F.size(pairs))


def citation_recall(pairs: Column) -> Column:
    """Share of pairs with some support; none: 1."""
    return F.when(F.size(pairs) == 0, 1.0).otherwise(share(pairs, lambda p: support(p["sentence"], p["cited"]) > 0))


def abstention(answer: Column) -> Column:
    return F.when(F.coalesce(answer, F.lit("")).rlike(HEDGES), 1.0).otherwise(0.0)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def set_f1(gold: Column, found: Column) -> Column:
    """F1 of two sets, of table cells for one; both empty: 1."""
    same = F.size(F.array_intersect(gold, found))
    total = F.size(F.array_distinct(gold)) + F.size(F.array_distinct(found))
    return F.when(total == 0, 1.0).otherwise(2.0 * same / F.greatest(total, F.lit(1)))


def type_accuracy(gold: Column, found: Column) -> Column:
    """Share of gold's keys (map id -> type) that are found with gold's type; empty: 1."""
    keys = F.map_keys(gold)
    return F.when(F.size(keys) == 0, 1.0).otherwise(share(keys, lambda k: F.coalesce(F.try_element_at(found, k) == F.element_at(gold, k), F.lit(False))))


def reading_order(gold: Column, found: Column) -> Column:
    """Kendall's tau over common ids, as a share of pairs in order; fewer than two: 1."""
    common = F.filter(gold, lambda g: F.array_contains(found, g))
    at = F.transform(common, lambda g: F.array_position(found, g))
    pairs = F.flatten(F.transform(at, lambda x, i: F.transform(F.slice(at, i + 2, F.greatest(F.size(at) - i - 1, F.lit(0))), lambda y: (y > x).cast("int"))))
    return F.when(F.size(common) < 2, 1.0).otherwise(F.aggregate(pairs, F.lit(0), lambda a, b: a + b) / F.greatest(F.size(pairs), F.lit(1)))


def table_cells(table: Column) -> Column:
    """array<struct<row, col, text>> of a pipe table: blank cells count in columns but are dropped."""
    rows = F.split(table, "\n")
    cells = F.transform(rows, lambda r, i: F.transform(F.split(r, r"\|"), lambda c, j: F.struct(i.alias("row"), j.alias("col"), F.trim(c).alias("text"))))
    return F.filter(F.flatten(cells), lambda c: c["text"] != "")


def order_scores(gold: DataFrame, found: DataFrame, by: list[str], key: str, place: str) -> DataFrame:
    """(by, n, reading_order) of rows (by, key, place): the share of pairs of common keys that both put in one order; groups with fewer than two are left out.

    Pairs that are swapped are counted bit by bit of a key's found rank: among
    the keys that agree in all higher bits, a key without the bit counts those
    with it that gold puts before it. That is a running sum, so a long document
    costs n log n rows and no list of pairs. Repeated keys have their first
    place; equal places are in the order of their keys.
    """
    once = lambda d, name: d.groupBy(*by, key).agg(F.min(place).alias(name))
    group = Window.partitionBy(*by)
    both = once(gold, "__g").join(once(found, "__f"), [*by, key])
    ranked = both.select(*by, F.row_number().over(group.orderBy("__g", key)).alias("g"), (F.row_number().over(group.orderBy("__f", key)) - 1).alias("f"), F.count("*").over(group).alias("n"))
    bits = ranked.where("n > 1").withColumn("b", F.explode(F.expr("sequence(0, length(bin(n - 1)) - 1)")))
    split = bits.withColumns({"one": F.expr("shiftright(f, b) & 1"), "prefix": F.expr("shiftright(f, b + 1)")})
    before = F.sum("one").over(Window.partitionBy(*by, "b", "prefix").orderBy("g"))
    swapped = split.withColumn("before", before).groupBy(*by, "n").agg(F.sum(F.when(F.col("one") == 0, F.col("before")).otherwise(0)).alias("swapped"))
    return swapped.select(*by, "n", (1.0 - F.col("swapped") * 2.0 / (F.col("n") * (F.col("n") - 1))).alias("reading_order"))


def parser_scores(parsed: DataFrame, gold: DataFrame, cells: DataFrame, parsers: list[str]) -> DataFrame:
    """(parser, document_id, type_accuracy, reading_order, table_f1) of every document of gold and every parser, whether the parser found something in it or not.

    parsed: (parser, document_id, element, ord, type, text). gold: (document_id,
    element, ord, type) as it should be. cells: (document_id, row, col, text) of
    all tables of a document, numbered within their table, equal ones once.
    Elements without gold count in no score but their cells in the table's. No
    gold element: type accuracy 1; no cell on both sides: table F1 1; fewer
    than two common elements: order 1. Of elements found twice the last type counts.
    """
    at = ["parser", "document_id"]
    graded = gold.select("document_id").unionByName(cells.select("document_id")).distinct().withColumn("parser", F.explode(F.array(*map(F.lit, parsers))))
    wanted = gold.withColumn("parser", F.explode(F.array(*map(F.lit, parsers))))
    last = parsed.groupBy(*at, "element").agg(F.max_by("type", F.struct("ord", "type")).alias("found"))
    types = wanted.join(last, [*at, "element"], "left").groupBy(*at).agg(F.avg(F.coalesce((F.col("type") == F.col("found")).cast("double"), F.lit(0.0))).alias("type_accuracy"))
    order = order_scores(wanted, parsed, at, "element", "ord")
    of_gold = cells.withColumn("parser", F.explode(F.array(*map(F.lit, parsers)))).select(*at, "row", "col", "text", F.lit(1).alias("g"), F.lit(0).alias("f"))
    of_found = parsed.where("type = 'Table'").select(*at, F.explode(table_cells(F.col("text"))).alias("c")).select(*at, "c.row", "c.col", "c.text", F.lit(0).alias("g"), F.lit(1).alias("f"))
    each = of_gold.unionByName(of_found).groupBy(*at, "row", "col", "text").agg(F.max("g").alias("g"), F.max("f").alias("f"))
    tables = each.groupBy(*at).agg((F.sum(F.col("g") * F.col("f")) * 2.0 / F.sum(F.col("g") + F.col("f"))).alias("table_f1"))
    out = graded.join(types, at, "left").join(order.drop("n"), at, "left").join(tables, at, "left")
    return out.select(*at, *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("type_accuracy", "reading_order", "table_f1")])


def normalised_number_text(text: str) -> str:
    import re

    text = unicodedata.normalize("NFKC", text)
    return re.sub(r"\s+", " ", re.sub(r"(\d),(\d)", r"\1\2", text))


def number_variants(value: float) -> list[str]:
    """How a number may be written: plain, or as whole multiples of Korean units."""
    whole = value == int(value)
    units = [f"{int(value // m)}{u}" for u, m in KOREAN_UNITS.items() if value >= m and value % m == 0]
    return [str(int(value)) if whole else str(value), *units]


@column_function("boolean")
def operand_found(value: pd.Series, text: pd.Series) -> pd.Series:
    """Whether a text holds the number in any of its forms, rounded to up to three digits too; no number or no text: false."""
    def of(v: float | None, t: str | None) -> bool:
        if t is None or v is None or not math.isfinite(v):
            return False
        hay = normalised_number_text(t)
        return any(form in hay for x in (v, *(round(v, d) for d in range(4))) for form in number_variants(x))

    return pd.Series([of(v, t) for v, t in zip(value, text, strict=True)])


@column_function("string")
def normalise_number_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalised_number_text(t))


def spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg((F.max(value) - F.min(value)).alias("spread"))


def winners(rows: DataFrame, metric: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The row of the greatest metric; of equal ones the first in order."""
    best = Window.partitionBy(*(by or [])).orderBy(F.desc(F.round(metric, 9)), order) if by else Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(metric, 9)), order)
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Report table of a few collected rows."""
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [columns, ["---"] * len(columns), *[[show(r.get(c)) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
