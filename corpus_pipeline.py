"""Corpus pipeline: quality rules, language ID, near-dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, packing, quality, simhash, substrings
from quern.llm.common import documents, drop_written, written
from quern.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language ID rejects texts without a letter and those whose best language is less likely than this.
LEAST_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; equal rows are judged alike, a null text goes, an empty table stays empty."""
    keyed = _keyed(docs)
    good = quality.judge(keyed, id_col="__row").where("kept").select("__row")
    return keyed.join(good, "__row", "left_semi").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; lang becomes the prediction. Null texts and texts without a letter go, equal rows become one."""
    model = langid.fit(docs)
    keyed = _keyed(docs)
    found = langid.predict(keyed, model, id_col="__row").where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return keyed.drop("lang").join(found.select("__row", F.col("lang_pred").alias("lang")).dropDuplicates(["__row"]), "__row").select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. Texts without a word are one group, null ids count as the largest."""
    return simhash.keep_one(docs).select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id holds too; a text that loses nothing stays as it is, null or empty too."""
    cut = substrings.dedup(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences; a null text is its end id alone."""
    return packing.pack_digest(docs, vocabulary("word_bpe_49k.json"))


def _keyed(docs: DataFrame) -> DataFrame:
    """__row names a row by id and text; equal rows share it and are judged alike."""
    return docs.select(COLUMNS).withColumn("__row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), "lang", "source").cast("string")))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Trained and iterative steps: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written and read again by the next, and deleted after it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
