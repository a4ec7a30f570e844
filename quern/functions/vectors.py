"""Vector expressions: hashed embeddings, cosine, quantisation. Vectors are array<double>, or long (bucket, weight) rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_tokens, words

DENSE_DIM = 256
TOKEN_DIM = 64
VOCABULARY = 1 << 20


def _hex(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def hash_bucket(token: Column, dim: int) -> Column:
    """First four SHA-1 bytes, big-endian, modulo dim."""
    return F.pmod(_hex(F.sha1(token.cast("binary")), 1, 8), F.lit(dim)).cast("int")


def hash_sign(token: Column) -> Column:
    """1 if the fifth SHA-1 byte is odd, else -1."""
    return F.when(_hex(F.sha1(token.cast("binary")), 9, 2) % 2 == 1, 1.0).otherwise(-1.0)


def hash_embedding(df: DataFrame, key: str | list[str], text: str, dim: int = DENSE_DIM) -> DataFrame:
    """(key, bucket, w): the non-zero coordinates of each text's unit vector; repeated words count.

    Sparse rows are joined on buckets, which no scan of all pairs has to do.
    Texts without words, and those whose words cancel, have no rows.
    """
    keys = [key] if isinstance(key, str) else key
    token = df.select(*keys, F.explode(words(F.col(text))).alias("t"))
    raw = token.groupBy(*keys, hash_bucket(F.col("t"), dim).alias("bucket")).agg(F.sum(hash_sign(F.col("t"))).alias("v"))
    norm = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.where("v <> 0").join(norm, keys).select(*keys, "bucket", (F.col("v") / F.col("norm")).alias("w"))


class WordHashes(dict):
    """Of each word twice the number that its first four SHA-1 bytes are, and one more if the fifth is odd. At most MOST words are held."""

    MOST = 1 << 18

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        d = hashlib.sha1(word.encode("utf-8", "surrogatepass")).digest()
        self[word] = code = int.from_bytes(d[:4], "big") << 1 | d[4] & 1
        return code


_HASHES = WordHashes()
_WORDS = re.compile(r"\w+")


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """WordHashes of the words of lower-cased texts, one text after another, and each text's number of words. A worker hashes a word once."""
    found = [_WORDS.findall(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum())), sizes


def unit_rows(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int, dim: int) -> pa.ListArray:
    """n vectors of the sums of values by row and bucket, each divided by its norm; zeros stay."""
    x = np.bincount(row * dim + bucket, weights=value, minlength=n * dim).reshape(n, dim)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.reshape(-1)))


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int = DENSE_DIM) -> DataFrame:
    """(key, vec): the same embedding as one array a text, without an exchange; zeros for texts without words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                codes, sizes = word_codes(b.column(1).to_pylist())
                vec = unit_rows(np.repeat(np.arange(b.num_rows), sizes), (codes >> 1) % dim, np.where(codes & 1, 1.0, -1.0), b.num_rows, dim)
                yield pa.RecordBatch.from_arrays([b.column(0), vec], names=[key, "vec"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.lower(F.col(text)).alias("text")).mapInArrow(pack, f"`{key}` {kind}, vec array<double>")


def dense(sparse: DataFrame, key: str, dim: int = DENSE_DIM) -> DataFrame:
    """(key, vec) of sparse rows."""
    m = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors: 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size == 0, x.cast("double")).otherwise(x / size))


def truncated(a: Column, dims: int) -> Column:
    """First coordinates, normalised again."""
    if dims < 1:
        raise ValueError("dims must be positive")
    return unit(F.slice(a, 1, dims))


def int8(a: Column) -> Column:
    """Scaled so that the largest magnitude is 127, rounded half to even; a zero vector stays zero."""
    peak = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.transform(a, lambda x: F.when(peak == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x * 127.0 / peak).cast("int")))).cast("int"))


def late_chunked(df: DataFrame, doc: str, order: str, vec: str, alpha: float = 0.3, window: int = 1) -> DataFrame:
    """Mix each chunk's vector with the mean of its neighbours' within a document, normalised: column `late`."""
    if not 0 <= alpha <= 1 or window < 0:
        raise ValueError("alpha must be in [0, 1] and window at least 0")
    from pyspark.sql import Window

    near = Window.partitionBy(doc, "dim").orderBy(order).rowsBetween(-window, window)
    long = df.select(doc, order, F.posexplode(vec).alias("dim", "x"))
    mixed = long.withColumn("y", (1 - alpha) * F.col("x") + alpha * F.avg("x").over(near))
    back = mixed.groupBy(doc, order).agg(F.array_sort(F.collect_list(F.struct("dim", "y"))).alias("l"))
    return df.join(back.select(doc, order, unit(F.transform("l", lambda e: e["y"])).alias("late")), [doc, order])


def instructed(text: Column, task: str) -> Column:
    """Query text of an instruction-tuned embedding."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), text)


def token_coordinates(token: Column, dim: int = TOKEN_DIM) -> Column:
    """array<struct<bucket, w>>: unit vector of one token of the late-interaction embedding.

    The 20 SHA-1 bytes are read as four windows of five bytes (bucket, sign),
    over and over until `dim` windows are read; windows that cancel leave the
    first coordinate alone.
    """
    digest = F.sha1(token.cast("binary"))
    times = [len(range(i, dim, 4)) for i in range(4)]
    parts = F.array(*[
        F.struct(
            F.pmod(_hex(digest, 1 + 10 * i, 8), F.lit(dim)).cast("int").alias("bucket"),
            (F.when(_hex(digest, 9 + 10 * i, 2) % 2 == 1, 1.0).otherwise(-1.0) * times[i]).alias("v"),
        )
        for i in range(4)
    ])
    buckets = F.array_distinct(F.transform(parts, lambda p: p["bucket"]))
    summed = F.transform(buckets, lambda b: F.struct(b.alias("bucket"), F.aggregate(F.filter(parts, lambda p: p["bucket"] == b), F.lit(0.0), lambda s, p: s + p["v"]).alias("v")))
    real = F.filter(summed, lambda p: p["v"] != 0)
    size = F.sqrt(F.aggregate(real, F.lit(0.0), lambda s, p: s + p["v"] * p["v"]))
    first = F.array(F.struct(F.lit(0).alias("bucket"), F.lit(1.0).alias("w")))
    return F.when(F.size(real) == 0, first).otherwise(F.transform(real, lambda p: F.struct(p["bucket"].alias("bucket"), (p["v"] / size).alias("w"))))


def text_tokens(text: Column) -> Column:
    """Lower-cased tokens of the late-interaction embedding; an empty text has the token <empty>."""
    t = blank_tokens(F.lower(text))
    return F.when(F.size(t) == 0, F.array(F.lit("<empty>"))).otherwise(t)


def patches(content: Column, n: int = 16) -> Column:
    """SHA-1 names of n runs of a binary: equal sizes, the rest in the last; an empty run is one zero byte."""
    size = F.greatest(F.lit(1), F.floor(F.octet_length(content) / n).cast("int"))

    def part(i: int) -> Column:
        length = size if i < n - 1 else F.greatest(F.octet_length(content) - i * size, F.lit(0))
        run = content.substr(i * size + 1, length)
        return F.sha1(F.when(F.octet_length(run) == 0, F.unhex(F.lit("00"))).otherwise(run))

    return F.array(*[part(i) for i in range(n)])
