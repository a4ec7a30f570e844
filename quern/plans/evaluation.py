"""Runs of named settings over evaluation cases, and their comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, words
from ..operators import metrics as M
from ..operators import tools
from . import pipelines as P
from .tables import written

#: Needles without an inner word are looked up by runs of so many characters, shorter ones by their whole.
GRAM = 3
KINDS = ("retrieval", "table", "computation")


def _rarest(asked: DataFrame, texts: DataFrame, cut: Callable[[Column], Column]) -> DataFrame:
    """(case_id, needle, chunk_id, text) of texts that hold the rarest key of a needle: candidates of one posting list for each needle.

    asked: (case_id, needle, keys). Texts' keys are cut to those that a needle
    has before they are counted and joined.
    """
    wanted = written(asked.select("case_id", "needle", F.explode("keys").alias("key")), "needle-keys")
    posts = written(texts.select("chunk_id", F.explode(cut(F.col("text"))).alias("key")).join(wanted.select("key").distinct(), "key"), "key-postings")
    sizes = posts.groupBy("key").agg(F.count("*").alias("n"))
    best = wanted.join(sizes, "key", "left").groupBy("case_id", "needle").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    return best.join(posts, "key").join(texts, "chunk_id")


def gold_by_substring(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, chunk_id, relevance): chunks that hold the case's `needle`, letter case aside.

    A needle's words but the first and the last are whole words of every text
    that holds it; a needle without such a word has runs of GRAM characters, or,
    if it is shorter, itself. The rarest of a needle's keys gives the texts that
    are searched for the needle itself. An empty needle is in every text, a
    null one in none.
    """
    low = cases.select("case_id", F.lower("needle").alias("needle")).where("needle is not null")
    inner = F.array_distinct(F.slice(words(F.col("needle")), 2, F.greatest(F.size(words(F.col("needle"))) - 2, F.lit(0))))
    keyed = low.withColumns({"inner": inner, "n": F.when(F.size(inner) > 0, -1).otherwise(F.least(F.length("needle"), F.lit(GRAM)))})
    texts = chunks.select("chunk_id", F.lower("text").alias("text")).where("text is not null")
    found = _rarest(keyed.where("n < 0").select("case_id", "needle", F.col("inner").alias("keys")), texts, lambda t: F.array_distinct(words(t)))
    for n in sorted(r[0] for r in keyed.where("n >= 0").select("n").distinct().collect()):  # 0 to GRAM
        found = found.unionByName(_rarest(keyed.where(F.col("n") == n).select("case_id", "needle", grams(F.col("needle"), n).alias("keys")), texts, lambda t, n=n: grams(t, n)))
    return found.where(F.contains("text", F.col("needle"))).select("case_id", "chunk_id").distinct().withColumn("relevance", F.lit(1.0))


def gold_dataset(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """gold_by_substring(), written; ValueError if a case's needle is in no chunk."""
    gold = written(gold_by_substring(chunks, cases), "gold")
    lost = cases.join(gold, "case_id", "left_anti").select("case_id", "needle").first()
    if lost is not None:
        raise ValueError(f"case {lost['case_id']!r}: no chunk contains {lost['needle']!r}; the gold label is unsatisfiable")
    return gold


def generated_gold(chunks: DataFrame, write: Callable[[Column], Column]) -> DataFrame:
    """Cases (case_id, query, needle) that a caller's model writes, one for each chunk; the chunk's text is the needle."""
    return chunks.select(F.concat(F.lit("gen-"), "chunk_id").alias("case_id"), write(F.col("text")).alias("query"), F.col("text").alias("needle"))


def guarded_cases(proposals: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, query, kind, chunk_ids, numbers, formula, expected_value): those of a model's proposals that chunks bear out.

    proposals: (case_id, kind, query, chunk_ids array<string>, numbers
    array<double>, operation). Chunk ids that name no chunk are taken out, and a
    case that has none left, or a kind that is none of KINDS, is dropped. So is
    a computation with a number that is in none of its chunks, as digits or in
    Korean units, or with an operation that can't be computed. The value of an
    operation is computed here and never taken from the model; without an
    operation it is null. Null chunk ids or numbers are empty ones; a null
    number is one that no chunk holds. case_id must be a key.
    """
    known = proposals.where(F.col("kind").isin(*KINDS)).withColumns({"chunk_ids": F.coalesce("chunk_ids", F.array().cast("array<string>")), "numbers": F.coalesce("numbers", F.array().cast("array<double>"))})
    named = written(known.select("case_id", F.posexplode("chunk_ids").alias("at", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id"), "named-chunks")
    ids = named.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda c: c["chunk_id"]).alias("chunk_ids"))
    computed = known.where("kind = 'computation'")
    asked = computed.select("case_id", F.explode(F.array_distinct("numbers")).alias("number"))
    seen = asked.where("number is not null").join(named.select("case_id", "text"), "case_id").withColumn("seen", M.operand_found(F.col("number"), F.col("text")))
    borne = seen.where("seen").select("case_id", "number").distinct()
    # a null equals no number in the join, so that its case is among the lost
    lost = asked.join(borne, ["case_id", "number"], "left_anti").select("case_id").distinct()
    value = F.when(F.col("operation") != "", tools.calculator(F.col("operation")))
    values = written(computed.select("case_id", value.alias("said")), "case-values")
    failed = values.where(F.startswith(F.col("said"), F.lit("Error"))).select("case_id")
    good = known.drop("chunk_ids").join(ids, "case_id").join(lost, "case_id", "left_anti").join(failed, "case_id", "left_anti").join(values, "case_id", "left")
    number = F.col("said").try_cast("double")
    return good.select("case_id", "query", "kind", "chunk_ids", F.when(F.col("kind") == "computation", F.col("numbers")).otherwise(F.array().cast("array<double>")).alias("numbers"), F.when(number.isNotNull(), F.col("operation")).alias("formula"), number.alias("expected_value"))


def run_modes(cases: DataFrame, index: P.Index, gold: DataFrame, k: int, modes: list[str], fusion: str = "rrf") -> DataFrame:
    """Mean retrieval metrics of each mode."""
    queries = cases.select(F.col("case_id").alias("query_id"), "query")

    def one(mode: str) -> DataFrame:
        hits = P.search_once(queries, index, P.Settings(mode=mode, fusion=fusion, top_k=k)).withColumnRenamed("query_id", "case_id")
        return M.ranking_metrics(hits, gold, cases, k).withColumn("mode", F.lit(mode))

    return reduce(DataFrame.unionByName, map(one, modes)).groupBy("mode").agg(*[F.avg(m).alias(m) for m in ("recall", "mrr", "ndcg", "context_precision")])


def generation_metrics(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Answer metrics of each case; those that need a reference are null without one."""
    rows = answers.withColumnRenamed("query_id", "case_id").join(cases.drop("query"), "case_id")
    contexts = F.coalesce("contexts", F.array().cast("array<string>"))
    ids = F.transform("citations", lambda c: c["chunk_id"])
    retrieved = F.coalesce("retrieved_ids", F.array().cast("array<string>"))
    ref = F.col("reference_answer")
    given = lambda c: F.when(ref.isNotNull(), c)
    return rows.select(
        "case_id", M.faithfulness(F.col("answer"), contexts).alias("faithfulness"), M.citation_faithfulness(ids, retrieved).alias("citation_faithfulness"), M.abstention(F.col("answer")).alias("abstention"),
        given(M.answer_correctness(F.col("answer"), ref)).alias("answer_correctness"), given(M.claim_recall(F.col("answer"), ref)).alias("claim_recall"), given(M.noise_sensitivity(F.col("answer"), contexts, ref)).alias("noise_sensitivity"),
    )


#: Settings that only change what is done with hits, those that change the hits of an index, and those that change an index of chunks.
AFTERWARDS = ("reranker", "mmr_lambda", "process_contexts", "rerank_top_k", "order", "generator", "tool_model")
SEARCHED = ("mode", "fusion", "top_k", "expand", "quantised", "rescore", "instruction", "query_embedder", "hypothesis")
ENCODED = ("contextual", "dim", "truncate", "late_chunking", "late_alpha", "embedder")
RETRIEVAL = ("recall", "mrr", "ndcg", "context_precision")


class Corpus:
    """Sources and cases of many runs. An index, its gold and the hits of a search are made once for all settings that are alike in what they depend on.

    index_of makes an index of settings. Cases: case_id, query, needle and, for
    metrics that compare with one, reference_answer.
    """

    def __init__(self, cases: DataFrame, index_of: Callable[[P.Settings], P.Index]) -> None:
        self.cases = cases if "reference_answer" in cases.columns else cases.withColumn("reference_answer", F.lit(None).cast("string"))
        self.queries = cases.select(F.col("case_id").alias("query_id"), "query")
        self._index_of = index_of
        self._made: dict[tuple[str, P.Settings], P.Index | DataFrame] = {}

    @classmethod
    def of(cls, sources: DataFrame, cases: DataFrame) -> Corpus:
        """Sources are parsed once, whatever is made of them."""
        parsed = P.parse(sources)
        return cls(cases, lambda settings: P.ingest_parsed(parsed, settings))

    def _once(self, what: str, settings: P.Settings, beside: tuple[str, ...], make: Callable[[], P.Index | DataFrame]) -> P.Index | DataFrame:
        """What `make` gives, made once for settings that differ in no other fields than `beside`."""
        usual = P.Settings()
        key = what, replace(settings, **{f: getattr(usual, f) for f in beside})
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def index(self, settings: P.Settings) -> P.Index:
        return self._once("index", settings, AFTERWARDS + SEARCHED, lambda: self._index_of(settings))

    def gold(self, settings: P.Settings) -> DataFrame:
        return self._once("gold", settings, AFTERWARDS + SEARCHED + ENCODED, lambda: written(gold_by_substring(self.index(settings).chunks, self.cases), "gold"))

    def hits(self, settings: P.Settings) -> DataFrame:
        return self._once("hits", settings, AFTERWARDS, lambda: written(P.retrieve(self.queries, self.index(settings), settings), "hits"))

    def _each(self, configs: dict[str, P.Settings], k: int, one: Callable[[P.Settings], DataFrame]) -> DataFrame:
        parts = [one(replace(s, top_k=k)).select(F.lit(i).alias("config_ord"), F.lit(n).alias("config"), "*") for i, (n, s) in enumerate(configs.items())]
        return reduce(DataFrame.unionByName, parts)

    def retrieved(self, configs: dict[str, P.Settings], k: int) -> DataFrame:
        """(config_ord, config, case_id, recall, mrr, ndcg, context_precision) of the best k."""
        return self._each(configs, k, lambda s: M.ranking_metrics(self.hits(s).withColumnRenamed("query_id", "case_id"), self.gold(s), self.cases, k))

    def answered(self, configs: dict[str, P.Settings], k: int) -> DataFrame:
        """(config_ord, config, case_id, metrics of answers) from the same hits."""
        return self._each(configs, k, lambda s: generation_metrics(P.answer_hits(self.hits(s), self.queries, self.index(s), s), self.cases))

    def measured(self, configs: dict[str, P.Settings], k: int) -> DataFrame:
        """Both for each case."""
        return self.retrieved(configs, k).join(self.answered(configs, k), ["config_ord", "config", "case_id"])


def _means(rows: DataFrame, keys: list[str]) -> list[Column]:
    return [F.avg(c).alias(c) for c in rows.columns if c not in {"case_id", *keys}]


def run_matrix(sources: DataFrame, cases: DataFrame, k: int, strategies: list[str], modes: list[str]) -> DataFrame:
    """Retrieval metrics of chunk strategies and modes, and each strategy's generation metrics (hybrid mode) beside them; gold is found anew in each strategy's chunks."""
    if unknown := {*strategies} - {*P.CHUNKERS}:
        raise ValueError(f"unknown chunk strategies: {sorted(unknown)}")
    corpus = Corpus.of(sources, cases)
    bases = {s: P.Settings(chunk_strategy=s) for s in strategies}
    found = reduce(DataFrame.unionByName, [corpus.retrieved({m: replace(b, mode=m) for m in modes}, k).select(F.lit(s).alias("strategy"), F.col("config").alias("mode"), *RETRIEVAL) for s, b in bases.items()])
    said = corpus.answered(bases, k).drop("config_ord").withColumnRenamed("config", "strategy")
    return found.groupBy("strategy", "mode").agg(*_means(found, ["strategy", "mode"])).join(said.groupBy("strategy").agg(*_means(said, ["strategy"])), "strategy")


def ablation(sources: DataFrame | Corpus, cases: DataFrame | None, configs: dict[str, P.Settings], k: int) -> DataFrame:
    """One row of mean metrics for each named configuration, ordered by config_ord. Configurations share what they have in common (Corpus)."""
    corpus = sources if isinstance(sources, Corpus) else Corpus.of(sources, cases)
    keys = ["config_ord", "config"]
    rows = corpus.measured(configs, k)
    return rows.groupBy(*keys).agg(*_means(rows, keys))


def best_by(rows: DataFrame, metric: str) -> DataFrame:
    return M.winners(rows, metric, "config_ord")


def profile(scenarios: dict[str, tuple[DataFrame, DataFrame] | Corpus], configs: dict[str, P.Settings], k: int) -> DataFrame:
    """Ablation of each scenario (sources, cases), and with a null scenario the means over the cases of all of them. Cases are scored once for both."""
    corpora = {n: s if isinstance(s, Corpus) else Corpus.of(*s) for n, s in scenarios.items()}
    rows = reduce(DataFrame.unionByName, [c.measured(configs, k).withColumn("scenario", F.lit(n)) for n, c in corpora.items()])
    keys = ["scenario", "config_ord", "config"]
    return rows.groupingSets([[F.col(c) for c in keys], [F.col(c) for c in keys[1:]]], *keys).agg(*_means(rows, keys))


def marked(profiled: DataFrame, metric: str) -> DataFrame:
    """profiled with `best`: whether a configuration has the scenario's greatest metric and is the first that has it."""
    best = Window.partitionBy("scenario").orderBy(F.desc_nulls_last(F.round(metric, 9)), "config_ord")
    return profiled.withColumn("best", F.row_number().over(best) == 1)


def strengths(profiled: DataFrame, metric: str) -> DataFrame:
    """(config, scenarios): where each configuration wins."""
    return marked(profiled.where("scenario is not null"), metric).where("best").groupBy("config").agg(F.array_sort(F.collect_list("scenario")).alias("scenarios"))


def profile_table(profiled: DataFrame, metric: str, configs: list[str]) -> DataFrame:
    """One metric as a table of scenarios by configurations, with the winner's name."""
    held = marked(profiled.where("scenario is not null"), metric)
    return held.groupBy("scenario").pivot("config", configs).agg(F.first(metric)).join(held.where("best").select("scenario", F.col("config").alias("best")), "scenario")


def computation(cases: DataFrame, index: P.Index, gold: DataFrame, k: int, model: Callable) -> DataFrame:
    """Numeric accuracy of the tool loop and recall of the search, for cases of kind `computation`."""
    own = cases.where("kind = 'computation'")
    hits = P.search_once(own.select(F.col("case_id").alias("query_id"), "query"), index, P.Settings(top_k=k)).withColumnRenamed("query_id", "case_id")
    recall = M.ranking_metrics(hits, gold, own, k).select("case_id", "recall")
    said = own.withColumn("said", tools.tool_answers(F.col("query"), model))
    return said.select("case_id", "said.value", M.numeric_accuracy(F.col("said.value"), F.col("expected_value")).alias("numeric_accuracy")).join(recall, "case_id")
