"""Language identification.

Sparse multinomial logistic regression over TF-IDF weights of hashed character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties;
a temperature, fitted on learnable rows that training left out, calibrates the
scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks

BITS = 15
DIM = 1 << BITS
ORDERS = (1, 2, 3, 4)
#: Bounds of the fitted sample: labelled rows of each language, rows of all, and the commonest languages, which alone can be predicted.
ROWS_PER_LANGUAGE = 1000
MOST_ROWS = 20_000
MOST_LANGUAGES = 200


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # langs x DIM
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


class Grams:
    """Hashed character n-gram counts of whole texts."""

    def __init__(self) -> None:
        fold = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            if (ch := chr(cp)).isalpha():
                low = ch.lower()
                fold[cp] = ord(low) if len(low) == 1 else cp
        self.fold = fold

    def counts(self, text: str | None) -> np.ndarray | None:
        """DIM counts; None if the text is null or has no letter."""
        if not text:
            return None
        cps = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = cps == 32
        if blank.all():
            return None
        cps = cps[~(blank & np.concatenate(([True], blank[:-1])))]  # runs of other characters become one blank
        cps = np.concatenate((np.array([32], np.uint32), cps, np.array([32], np.uint32)))
        total = np.zeros(DIM, np.int64)
        run = cps * np.uint32(0x9E3779B1)
        for n in ORDERS:
            if n > 1:
                run = (run[:-1] ^ (run[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + cps[n - 1 :] * np.uint32(0xC2B2AE3D)
            if len(run) == 0:
                break
            mixed = (run ^ (run >> np.uint32(16))) * np.uint32(0x27D4EB2F)
            total += np.bincount(mixed >> np.uint32(32 - BITS), minlength=DIM)
        return total


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2 (null id: not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _learnable(docs: DataFrame, text: str, lang: str, id_col: str) -> DataFrame:
    ok = ~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()
    return docs.where(ok).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(id_col)).alias("pick"))


def document_frequencies(learn: DataFrame) -> DataFrame:
    """(gram, n): in how many learnable texts each hashed n-gram occurs; gram -1 has the number of texts. Counts cover all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen, n = Grams(), np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                c = grams.counts(t)
                if c is not None:
                    seen += c > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"gram": pa.array([-1, *range(DIM)], pa.int32()), "n": pa.array([n, *seen.tolist()], pa.int64())})

    return learn.select("text").mapInArrow(count, "gram int, n long").where("n > 0").groupBy("gram").agg(F.sum("n").alias("n"))


def sample(learn: DataFrame, per_language: int) -> DataFrame:
    """(lang, pick, grams, counts) of rows of least hash of the MOST_LANGUAGES commonest languages, with a surplus that train() cuts to per_language rows each, or less where many languages share MOST_ROWS."""
    sizes = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    sizes = sizes.withColumn("most", F.least(F.lit(per_language), F.floor(F.lit(MOST_ROWS) / F.count("*").over(Window.partitionBy(F.lit(0))))))
    part = F.least(F.lit(1.0), 1.3 * F.col("most") / F.col("count"))
    kept = learn.join(F.broadcast(sizes), "lang").where(F.pmod("pick", F.lit(1 << 20)) < F.floor(part * (1 << 20)) + 1)  # MOST_LANGUAGES rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in text_blocks(batches, "text"):
            texts, langs, picks, most = (b.column(i).to_pylist() for i in range(4))
            out = {"lang": [], "pick": [], "most": [], "grams": [], "counts": []}
            for t, *row in zip(texts, langs, picks, most, strict=True):
                c = grams.counts(t)
                if c is not None:
                    at = np.flatnonzero(c)
                    for name, value in zip(out, [*row, at.astype(np.uint16).tobytes(), c[at].astype(np.float32).tobytes()], strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, {"lang": pa.string(), "pick": pa.int64(), "most": pa.int64()}.get(k, pa.binary())) for k, v in out.items()})

    return kept.select("text", "lang", "pick", F.col("most").cast("long").alias("most")).mapInArrow(featurise, "lang string, pick long, most long, grams binary, counts binary")


def _weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """Follow the regularised leader, one row at a time; every fifth row calibrates the temperature."""
    langs = sorted({r[0] for r in rows})
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    k = len(langs)
    data = [(langs.index(lang), at, _weigh(at, c.astype(np.float64), idf)) for lang, at, c in rows]
    fit, check = [d for i, d in enumerate(data) if i % 5 != 4], [d for i, d in enumerate(data) if i % 5 == 4]
    # the last column is the bias, which has no penalty
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def leader(at: np.ndarray) -> np.ndarray:
        zz, pen = z[at], np.where(at == DIM, 0.0, 1.0)[:, None]
        return np.where(np.abs(zz) <= l1 * pen, 0.0, -(zz - np.sign(zz) * l1 * pen) / ((beta + np.sqrt(n[at])) / alpha + l2 * pen))

    for _ in range(epochs if k > 1 else 0):
        for y, at, x in fit:
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = leader(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sq = g * g
            z[at] += g - (np.sqrt(n[at] + sq) - np.sqrt(n[at])) / alpha * w
            n[at] += sq
    full = leader(np.arange(DIM + 1))
    model = Model(langs, full[:DIM].T.copy(), full[DIM].copy(), idf, 1.0)
    if k > 1 and check:
        logits = np.array([x @ full[at] + model.bias for _, at, x in check])
        ys = np.array([y for y, _, _ in check])
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(ys)), ys], 1e-12)).mean()
        lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(60):  # golden section
            a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
        model.temperature = float(np.exp((lo + hi) / 2))
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows that are not held out. Document frequencies cover all of them, weights a bounded sample.

    One task trains, on the sample and the frequencies; the driver gets the model alone.
    """
    learn = _learnable(docs, text, lang, id_col)
    kinds = "lang string, pick long, most long, grams binary, counts binary, gram int, n long"
    rows = sample(learn, per_language).unionByName(document_frequencies(learn), allowMissingColumns=True).select(*(c.split()[0] for c in kinds.split(", ")))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, df, n_docs = [], np.zeros(DIM, np.int64), 0
        for b in batches:
            for language, pick, most, grams, counts, gram, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if gram is None:
                    held.append((pick, language, grams, counts, most))
                elif gram < 0:
                    n_docs = n
                else:
                    df[gram] = n
        held.sort(key=lambda r: r[:4])
        took: dict[str, int] = {}
        found = []
        for _, language, grams, counts, most in held:
            took[language] = took.get(language, 0) + 1
            if took[language] <= most:
                found.append((language, np.frombuffer(grams, np.uint16).astype(np.int32), np.frombuffer(counts, np.float32)))
        m = train(found, df, n_docs)
        yield pa.RecordBatch.from_pydict({
            "langs": pa.array([m.langs], pa.list_(pa.string())), "weights": pa.array([m.weights.astype(np.float64).tobytes()], pa.binary()), "bias": pa.array([m.bias.astype(np.float64).tobytes()], pa.binary()),
            "idf": pa.array([m.idf.astype(np.float64).tobytes()], pa.binary()), "temperature": pa.array([m.temperature], pa.float64()),
        })

    r = rows.repartition(1).mapInArrow(learned, "langs array<string>, weights binary, bias binary, idf binary, temperature double").first()
    return Model(list(r["langs"]), np.frombuffer(r["weights"], np.float64).reshape(-1, DIM), np.frombuffer(r["bias"], np.float64), np.frombuffer(r["idf"], np.float64), r["temperature"])


def predict(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, lang_pred, score) of every whole text, one row for each row of docs.

    Only the text is read. Null texts and texts without a letter are `und`
    with score 0, as is every text when nothing could be learnt; with a single
    learnt language that one is predicted with score 1. Repeated rows repeat;
    an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights for each language

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = sent.value, Grams()
        weights = (m.weights * m.idf).T.copy()
        for b in text_blocks(batches, "text"):
            langs, scores = [], []
            for t in b.column(1).to_pylist():
                c = grams.counts(t) if m.langs else None
                if c is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = np.flatnonzero(c)
                tf = np.log1p(c[at])
                norm = np.sqrt(((tf * m.idf[at]) ** 2).sum())
                p = _softmax((tf @ weights[at] / norm + m.bias) / m.temperature)
                best = int(p.argmax())
                langs.append(m.langs[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(judge, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents."""
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
