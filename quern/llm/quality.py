"""Quality rules with adaptive thresholds.

Each feature's distribution is sketched per language and source, by a
log-bucket quantile sketch: a value's bucket is the integer power of GAMMA
that bounds it, so a sketch is a set of counted buckets, two sketches merge by
adding counts in any order, and every quantile is within REL of the true one.
Thresholds are fences around the group's median. Every group's sketch is
topped up by PRIOR documents spread like its language's sketch, and that by as
many spread like all documents: a small group leans on its parents, a large
one on itself, and nothing switches at a size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks, written

#: Relative error of a quantile.
REL = 0.01
GAMMA = (1 + REL) / (1 - REL)
#: Values up to this are one bucket.
TINY = 1e-6
#: Documents' worth of its parent's sketch that each sketch is topped up by.
PRIOR = 20
#: feature -> (fence in spreads, least spread, two-sided). Spread: distance of the quartiles from the median.
FENCES = {
    "mean_word_chars": (16.0, 0.15, True),
    "symbols_per_word": (8.0, 0.025, False),
    "dup_line_share": (8.0, 0.06, False),
    "repeat_share": (8.0, 0.03, False),
}
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLANKS = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(n)
    for i, window in enumerate(zip(*(words[k:] for k in range(width)), strict=False)):
        at = first.setdefault(window, i)
        if at != i:
            hit[at] = hit[i] = 1
    if not any(hit):
        return 0
    starts = np.flatnonzero(np.frombuffer(hit, np.uint8))
    covered = np.zeros(n + width, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTS and the number of lines with a word, of one whole text (null: empty)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(raw.count, (bytes([b]) for b in _BLANKS)))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep columns and the counts of every whole text. Null texts count as empty; repeated rows stay."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "__text"):
            rows = [text_counts(t) for t in b.column(len(keep)).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [b.column(i) for i in range(len(keep))] + [pa.array(c, pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *COUNTS, "n_lines"])

    schema = fields + "".join(f", {c} long" for c in [*COUNTS, "n_lines"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
    }


def bucket(value: Column) -> Column:
    """Sketch bucket of a value >= 0."""
    return F.when(value <= TINY, F.lit(-(1 << 20))).otherwise(F.ceil(F.log(value) / math.log(GAMMA))).cast("int")


def bucket_value(b: Column) -> Column:
    return F.when(b == -(1 << 20), F.lit(0.0)).otherwise(2.0 * F.pow(F.lit(GAMMA), b) / (GAMMA + 1))


def sketch(measured: DataFrame) -> DataFrame:
    """(g_lang, g_source, feature, bucket, n): mergeable sketches of documents that pass the base rules.

    Groups: null languages and sources form groups of their own. Partial counts are made before the exchange.
    """
    long = measured.where(~base_failed()).select(
        "g_lang", "g_source",
        F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), bucket(v).alias("bucket")) for k, v in features().items()])).alias("f"),
    )
    return long.groupBy("g_lang", "g_source", "f.feature", "f.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches to coarser groups: counts of equal buckets add up."""
    return sketches.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


def topped_up(sketches: DataFrame, parents: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """(by, feature, bucket, n): the counts of each sketch and PRIOR documents, spread like the sketch of its parent, whose key is on."""
    total = parents.groupBy(*on, "feature").agg(F.sum("n").alias("total"))
    share = parents.join(total, [*on, "feature"]).select(*on, "feature", "bucket", (F.lit(float(PRIOR)) * F.col("n") / F.col("total")).alias("n"))
    lent = sketches.select(*by, "feature").distinct().join(share, [*on, "feature"]).select(*by, "feature", "bucket", "n")
    own = sketches.select(*by, "feature", "bucket", F.col("n").cast("double").alias("n"))
    return merge(own.unionByName(lent), by)


def quantiles(sketches: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """(by, feature, total, one column for each of probs); counts may be fractions, sums of which are equal to a billionth."""
    run = Window.partitionBy(*by, "feature").orderBy("bucket")
    whole = Window.partitionBy(*by, "feature")
    ranked = sketches.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(whole)})
    least = [F.min(F.when(F.col("upto") >= p * F.col("total") - 1e-9 * F.col("total"), F.col("bucket"))).alias(k) for k, p in probs.items()]
    found = ranked.groupBy(*by, "feature").agg(F.max("total").alias("total"), *least)
    return found.withColumns({k: bucket_value(F.col(k)) for k in probs})


def thresholds(sketches: DataFrame) -> DataFrame:
    """(g_lang, g_source, lo_<feature>, hi_<feature>): the fences of every group."""
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    of_lang = topped_up(merge(sketches, ["g_lang"]), merge(sketches, []), [], ["g_lang"])
    both = quantiles(topped_up(sketches, of_lang, ["g_lang"], ["g_lang", "g_source"]), ["g_lang", "g_source"], probs)
    name = F.col("feature")
    reach = lambda a, b, k, least: k * F.greatest(F.abs(F.col(b) - F.col(a)), F.lit(least))
    hi = lo = F.lit(None).cast("double")
    for f, (k, least, two) in FENCES.items():
        hi = F.when(name == f, F.col("q2") + reach("q2", "q3", k, least)).otherwise(hi)
        lo = F.when(name == f, F.col("q2") - reach("q1", "q2", k, least) if two else F.lit(-1.0)).otherwise(lo)
    fences = both.select("g_lang", "g_source", "feature", lo.alias("lo"), hi.alias("hi"))
    pick = lambda side, f: F.max(F.when(name == f, F.col(side))).alias(f"{side}_{f}")
    return fences.groupBy("g_lang", "g_source").agg(*[pick(s, f) for f in FENCES for s in ("lo", "hi")])


def judge(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id_col, COUNTS, base_failed, kept), one row for each row of docs.

    kept is false where base_failed; else whether every feature lies within
    its group's fences. A group without a scored document has no fence and
    keeps all it holds. Null text: no words, so base_failed. An empty table
    gives an empty result. The fences are one row for each language and
    source; they are joined, not broadcast by hand.
    """
    slim = docs.select(F.col(id_col).alias("doc_key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    raw = measure(slim, keep=("doc_key", "lang", "source"))
    measured = written(raw.withColumns({"g_lang": _group("lang"), "g_source": _group("source")}).drop("lang", "source"), "quality-counts")
    fences = written(thresholds(sketch(measured)), "quality-fences")
    inside = F.lit(True)
    for f, value in features().items():
        ok = (value <= F.col(f"hi_{f}")) & (value >= F.col(f"lo_{f}"))
        inside = inside & F.coalesce(ok, F.lit(True))
    joined = measured.join(fences, ["g_lang", "g_source"], "left")
    failed = base_failed()
    return joined.select(F.col("doc_key").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def _group(column: str) -> Column:
    """Null-safe group key."""
    return F.concat(F.when(F.col(column).isNull(), "0").otherwise("1"), F.coalesce(F.col(column).cast("string"), F.lit("")))
