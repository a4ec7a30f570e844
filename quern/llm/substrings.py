"""Substring dedup: windows of 50 words, dealt by super-k-mers and counted by sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_words, text_blocks, without
from .windows import Runs, Spec, merged, repeated_spans, with_spans

SPEC = Spec("word", 50, 16)


def window_classes(ids: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal windows of `length` ids, by sorting: ranks of 1, 2, 4, ... ids, the last two overlapping."""
    rank, width = ids, 1
    while width < length:
        step = min(width, length - width)
        pair = rank[:-step].astype(np.uint64) << np.uint64(32) | rank[step:].astype(np.uint64)
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    return rank


def sort_windows(length: int):  # noqa: ANN201
    """resolve() for windows of words: of each window the least id of all equal ones."""

    def resolve(packed: list[bytes], n: np.ndarray, cnt: np.ndarray, least: np.ndarray) -> list[Runs]:
        words = [p.split(b" ") for p in packed]
        flat = [w for ws in words for w in ws]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[of]
        kind = window_classes(ids, length)[at]
        order = np.argsort(kind, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], kind[order][1:] != kind[order][:-1])))
        lows = np.minimum.reduceat(least[of][order], heads)
        low = np.empty(len(of), np.int64)
        low[order] = np.repeat(lows, np.diff(np.append(heads, len(of))))
        cuts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (low[1:] != low[:-1]))))
        out: list[Runs] = [[] for _ in packed]
        first = np.cumsum(n) - n
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
            out[of[a]].append((int(a - first[of[a]]), b - a, int(low[a])))
        return out

    return resolve


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", spec: Spec = SPEC) -> DataFrame:
    """docs and n_words, n_removed, kept_text: words of windows that also start in a row of smaller id are removed.

    kept_text joins the kept words by one space; where nothing was removed
    too. Null texts have no words and an empty kept_text. Rows of one id never
    remove each other; null ids count as the largest. An empty table gives an
    empty result. Columns of docs stay, but for those of one of the three
    names, which are replaced (ValueError if it is the text's or the id's).
    """
    docs = without(docs, ["n_words", "n_removed", "kept_text"], text, id_col)
    spans = repeated_spans(docs, spec, sort_windows(spec.length), across=True, text=text, id_col=id_col)
    joined = with_spans(docs, spans, text, id_col, "__spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text):
            n, gone, kept = [], [], []
            for t, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                words = split_words(t)
                n.append(len(words))
                for s, e in reversed(merged(spans)):
                    del words[s:e]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*b.schema.names[:-1], "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, fields + ", n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
