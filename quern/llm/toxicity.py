"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over words, and beginnings of words, that tell the
labels apart. A bounded
sample of labelled rows is indexed as postings in blocks, with the greatest
weight of each term in each block. A query visits blocks by descending bound
until no other can hold one of its nearest examples, so its neighbours by
cosine are exact. Their votes, weighted by distance, are calibrated on the
examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, text_blocks, written
from .langid import held_out

#: Bound of the fitted sample: examples of each label, by least hash of id and text.
EXAMPLES = 8_000
#: Words of a vector: those of the sample whose likelihood ratio with the label is highest, at most so many,
MOST_TERMS = 1024
#: and only if chance would give a ratio so high to less than this share of the vocabularies.
CHANCE = 0.01
#: Letters of the beginnings of words that are terms beside the words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Nearest examples that vote; more if the last ones are equally near.
NEIGHBOURS = 24
BLOCK = 64
#: Queries that are searched together.
TOGETHER = 256
#: Votes of the sample's share of toxic examples that each score starts with.
PRIOR = 1.0
#: A score from here on is predicted toxic.
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_EQUAL = 1e-9


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word and, marked by a star, its beginnings: inflected words share them."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def row_pick(text: str = "text", id_col: str = "doc_id") -> Column:
    """A hash that names a row by its id and text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit("")))


@dataclass
class Sample:
    """(pick, toxic) of the examples and, of each label, the number of labelled rows and of examples."""

    rows: list[tuple[int, int]]
    labelled: dict[int, int]
    taken: dict[int, int]

    def table(self, docs: DataFrame) -> DataFrame:
        return F.broadcast(docs.sparkSession.createDataFrame(self.rows, "pick long, toxic int"))  # 2 * EXAMPLES rows


def sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Sample:
    """At most `examples` rows of each label that are not held out, by least hash of id and text.

    Only ids, hashes and labels are exchanged. Of several labels of an id the
    toxic one counts; null labels and ids don't. Equal rows are one example.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", row_pick().alias("pick")).distinct().join(marks, "doc_id")
    rows = written(rows.select("pick", "toxic"), "toxicity-labelled")
    labelled = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = [(r["pick"], y) for y in labelled for r in rows.where(F.col("toxic") == y).select("pick").orderBy("pick").limit(examples).collect()]
    drop_written(rows)
    return Sample(found, labelled, Counter(y for _, y in found))


def likelihood_ratio(a: str, b: str, na: float, nb: float) -> str:
    """Twice the log likelihood ratio, in SQL, of a of na and b of nb examples having a word against one rate for both."""
    def part(seen: str, expected: str) -> str:
        return f"IF({seen} > 0, 2 * ({seen}) * ln(({seen}) / ({expected})), 0D)"

    n = na + nb
    return " + ".join([
        part(a, f"({a} + {b}) * {na / n!r}D"), part(b, f"({a} + {b}) * {nb / n!r}D"),
        part(f"({na!r}D - {a})", f"({n!r}D - {a} - {b}) * {na / n!r}D"), part(f"({nb!r}D - {b})", f"({n!r}D - {a} - {b}) * {nb / n!r}D"),
    ])


def vocabulary(docs: DataFrame, chosen: Sample) -> list[str]:
    """The words of the sample that tell the labels apart, at most MOST_TERMS, best first; none if it has one label only."""
    if len(chosen.taken) < 2:
        return []

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in text_blocks(iter([b])):
                found = [sorted({f for w in set(words(t)) for f in features(w)}) for t in block.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column(1), block.column(2), pa.array(found, pa.list_(pa.string()))], names=["pick", "toxic", "words"])

    picked = docs.where(~held_out()).select("text", row_pick().alias("pick")).join(chosen.table(docs), "pick").select("text", "pick", "toxic")
    rows = picked.mapInArrow(spell, "pick long, toxic int, words array<string>").dropDuplicates(["pick"]).select("toxic", F.explode("words").alias("term"))
    terms = rows.groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.count_if(F.col("toxic") == 0).cast("double").alias("b"))
    terms = written(terms.withColumn("ratio", F.expr(likelihood_ratio("a", "b", float(chosen.taken[1]), float(chosen.taken[0])))), "toxicity-terms")
    least = 2 * np.log(max(1, terms.count()) / CHANCE)
    best = [r["term"] for r in terms.where(F.col("ratio") >= float(least)).orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).collect()]
    drop_written(terms)
    return best


def vectors(docs: DataFrame, terms: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id_col, held_out, pick, terms, counts) of every whole text: numbers of its vocabulary terms, ascending, and their counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})  # MOST_TERMS words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = sent.value, {}
        for b in batches:
            for block in text_blocks(iter([b])):
                at, times = [], []
                for t in block.column(3).to_pylist():
                    seen: Counter = Counter()
                    for w, n in Counter(words(t)).items():
                        if (own := numbers.get(w)) is None:
                            own = numbers[w] = [known[f] for f in features(w) if f in known]
                        for i in own:
                            seen[i] += n
                    if len(numbers) > 200_000:
                        numbers.clear()
                    at.append(sorted(seen))
                    times.append([seen[i] for i in at[-1]])
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), block.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=[id_col, "held_out", "pick", "terms", "counts"])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), row_pick("text", id_col).alias("pick"), "text")
    return rows.mapInArrow(count, f"`{id_col}` {kind}, held_out boolean, pick long, terms array<int>, counts array<int>")


def document_frequencies(vecs: DataFrame, terms: int) -> np.ndarray:
    """In how many rows each vocabulary term occurs. Each task adds up its rows; the driver gets at most `terms` sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for b in batches:
            seen += np.bincount(b.column(0).flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["term", "n"])

    df = np.zeros(terms, np.int64)
    if terms:
        for r in vecs.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r["term"]] = r["n"]
    return df


@dataclass
class Index:
    """Different example vectors in blocks of BLOCK. A block holds its terms and their postings as a small matrix; bounds has each term's greatest weight in each block."""

    idf: np.ndarray
    toxic: np.ndarray  # weight of a vector's toxic examples,
    whole: np.ndarray  # and of all of them
    name: list  # the least id of a vector's examples
    keys: list  # (terms, counts) of each vector
    bounds: np.ndarray  # terms x blocks
    blocks: list[tuple[np.ndarray, np.ndarray]]  # terms, ascending, and weights: terms x vectors
    prior: float
    slope: float = 1.0
    offset: float = 0.0
    zero: int = -1
    visited: int = 0  # blocks that searches have looked into

    def weigh(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        x = (1 + np.log(times)) * self.idf[at]
        return x / np.sqrt((x * x).sum()) if len(x) else x


def index(examples: list[tuple], df: np.ndarray, n_docs: int, share: dict[int, float]) -> Index:
    """The index of (terms, counts, label, id) examples; share weighs each label's examples so that the sample has all labelled rows' proportions."""
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    same: dict[tuple, list[tuple[int, int]]] = {}
    for at, times, y, i in examples:
        same.setdefault((at, times), []).append((y, i))
    # alike vectors are neighbours, so that a block's bounds are close
    keys = sorted(same, key=lambda k: (tuple(sorted(k[0], key=lambda t: (-idf[t], t))), k[1]))
    toxic, whole = (np.array([sum(share[y] for y, _ in same[k] if y or every) for k in keys]) for every in (0, 1))
    blocks = -(-len(keys) // BLOCK)
    own = Index(idf, toxic, whole, [min(i for _, i in same[k]) for k in keys], keys, np.zeros((len(df), blocks)), [], float(toxic.sum() / whole.sum()) if keys else 0.0)
    own.zero = next((i for i, k in enumerate(keys) if not k[0]), -1)
    for b in range(blocks):
        part = keys[b * BLOCK : (b + 1) * BLOCK]
        head = np.array(sorted({t for at, _ in part for t in at}), np.int64)
        held = np.zeros((len(head), len(part)))
        for j, (at, times) in enumerate(part):
            a = np.array(at, np.int64)
            held[np.searchsorted(head, a), j] = own.weigh(a, np.array(times, np.float64))
        own.blocks.append((head, held))
        own.bounds[head, b] = held.max(axis=1)
    return own


def nearest(own: Index, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (terms, weights) the example vectors of the k highest cosines above zero, all that tie with the last included, best first; exact.

    Each query first looks into the blocks of its highest bounds, which gives it
    a k-th cosine, then into every block whose bound reaches that. but: a vector
    for each query that is left out, -1 for none.
    """
    m, n = len(queries), len(own.blocks)
    dense = np.zeros((m, len(own.idf)))
    for i, (at, w) in enumerate(queries):
        dense[i, at] = w
    most = dense @ own.bounds
    hidden = np.full(m, -1) if but is None else np.array(but, np.int64)
    held, least, seen = np.zeros((m, k)), np.zeros(m), np.zeros((m, n), bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(b: int, rows: np.ndarray) -> None:
        head, weights = own.blocks[b]
        seen[rows, b] = True
        own.visited += len(rows)
        sims = dense[np.ix_(rows, head)] @ weights
        mine = np.flatnonzero((hidden[rows] >= 0) & (hidden[rows] // BLOCK == b))
        sims[mine, hidden[rows[mine]] % BLOCK] = 0
        r, c = np.nonzero(sims > np.maximum(0, least[rows] - _EQUAL)[:, None])
        found.append((rows[r], c + b * BLOCK, sims[r, c]))
        held[rows] = -np.partition(-np.concatenate((held[rows], sims), axis=1), k - 1, axis=1)[:, :k]
        least[rows] = held[rows].min(axis=1)

    for _ in range(2 if n else 0):
        best = np.where(seen, -1.0, most).argmax(axis=1)
        for b in np.unique(best).tolist():
            look(b, np.flatnonzero((best == b) & ~seen[:, b]))
    for b in np.argsort(-most.sum(axis=0), kind="stable").tolist():
        rows = np.flatnonzero(~seen[:, b] & (most[:, b] > 0) & (most[:, b] >= least - _EQUAL))
        if len(rows):
            look(b, rows)
    if not found:
        return [(np.zeros(0, np.int64), np.zeros(0))] * m
    q, e, s = (np.concatenate(x) for x in zip(*found, strict=True))
    s = np.round(s, 9)
    ok = (s > 0) & (s >= np.round(least, 9)[q])
    q, e, s = q[ok], e[ok], s[ok]
    order = np.lexsort((e, -s, q))
    q, e, s = q[order], e[order], s[order]
    cuts = np.searchsorted(q, np.arange(m + 1))
    return [(e[a:z], s[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def vote(own: Index, at: np.ndarray, sims: np.ndarray, but: tuple[int, float, float] | None = None) -> float:
    """Share of toxic votes; a vote counts cosine**2 / (1.02 - cosine), PRIOR votes go to the examples' own share. but: (vector, toxic, all) weight not to count."""
    toxic, whole = own.toxic[at], own.whole[at]
    if but is not None:
        toxic, whole = toxic - np.where(at == but[0], but[1], 0), whole - np.where(at == but[0], but[2], 0)
    near = np.minimum(sims, 1.0)
    w = near * near / (1.02 - near)
    return float((PRIOR * own.prior + (w * toxic).sum()) / (PRIOR + (w * whole).sum()))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to labels: Newton's steps with a small penalty."""
    x, w = _logit(votes), weights / weights.sum()
    b = np.array([1.0, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(b[0] * x + b[1], -30, 30)))
        g = np.array([(w * (z - labels) * x).sum() + 1e-3 * (b[0] - 1), (w * (z - labels)).sum() + 1e-3 * b[1]])
        v = w * z * (1 - z)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def scored(own: Index, raw: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(own.slope * _logit(np.array(raw)) + own.offset, -30, 30))))


def search(own: Index, vectors: list[tuple[list[int], list[int]]], but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """nearest() of vectors (terms, counts), TOGETHER at once; the examples without vocabulary terms are those of a text without any."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.array([own.zero]), np.ones(1)) if own.zero >= 0 else (np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
    some = [i for i, (at, _) in enumerate(vectors) if at]
    for s in range(0, len(some), TOGETHER):
        part = some[s : s + TOGETHER]
        asked = [(np.array(vectors[i][0], np.int64), own.weigh(np.array(vectors[i][0], np.int64), np.array(vectors[i][1], np.float64))) for i in part]
        for i, near in zip(part, nearest(own, asked, but=None if but is None else [but[i] for i in part]), strict=True):
            out[i] = near
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Index, DataFrame]:
    """The calibrated index, and the vectors of all rows as a written table.

    Document frequencies cover all rows of docs; the driver gets the examples'
    short vectors, of at most 2 * EXAMPLES rows.
    """
    chosen = sample(docs, labels)
    terms = vocabulary(docs, chosen)
    vecs = written(vectors(docs, terms), "toxicity-vectors")
    df = document_frequencies(vecs, len(terms))
    own_rows = vecs.where(~F.col("held_out")).join(chosen.table(docs), "pick").dropDuplicates(["pick"])
    share = {y: chosen.labelled[y] / chosen.taken[y] for y in chosen.taken}
    examples = [(tuple(r["terms"]), tuple(r["counts"]), r["toxic"], r["doc_id"]) for r in own_rows.orderBy("pick").collect()]
    own = index(examples, df, vecs.count(), share)
    if len(chosen.taken) == 2:
        places = {k: i for i, k in enumerate(own.keys)}
        sent = docs.sparkSession.sparkContext.broadcast((own, places))

        def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, of = sent.value
            for b in batches:
                rows = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                raw = [
                    vote(ix, near, sims, (of[tuple(at), tuple(times)], share[y] * y, share[y]))
                    for (at, times, y), (near, sims) in zip(rows, search(ix, [r[:2] for r in rows]), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), b.column(2)], names=["raw", "toxic"])

        tried = own_rows.select("terms", "counts", "toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(leave_out, "raw double, toxic int").collect()
        raw, y = np.array([r["raw"] for r in tried]), np.array([r["toxic"] for r in tried])
        own.slope, own.offset = calibration(raw, y, np.where(y == 1, share[1], share[0]))
    return own, vecs


def assess(docs: DataFrame, labels: DataFrame, shown: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every whole text, one row for each row of docs.

    Scores come from the text alone. Null and empty texts, and others without a
    word of the vocabulary, are judged by the examples without one. With no
    labelled example the score is 0, with one label only that label's share.
    evidence: the nearest examples' least id, cosine and toxic share, at most
    `shown`. Repeated rows repeat, also as queries; null ids are scored and
    teach nothing. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own, vecs = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(own)  # 2 * EXAMPLES vectors of at most MOST_TERMS words
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<struct<doc_id:{kind},cosine:double,toxic_share:double>>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, seen = sent.value, {}
        for b in batches:
            rows = [(tuple(at), tuple(times)) for at, times in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            if len(seen) > 20_000:
                seen.clear()
            fresh = [r for r in dict.fromkeys(rows) if r not in seen]
            for row, (near, sims) in zip(fresh, search(ix, fresh), strict=True):
                show = [{"doc_id": ix.name[i], "cosine": float(c), "toxic_share": float(ix.toxic[i] / ix.whole[i])} for i, c in zip(near[:shown].tolist(), sims[:shown], strict=True)]
                seen[row] = (scored(ix, vote(ix, near, sims)) if len(ix.whole) else 0.0), show
            scores, shows = zip(*(seen[r] for r in rows), strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32()),
                pa.array(shows, pa.list_(pa.struct([("doc_id", b.schema.field(0).type), ("cosine", pa.float64()), ("toxic_share", pa.float64())]))),
            ], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return vecs.select("doc_id", "held_out", "terms", "counts").mapInArrow(judge, schema)
