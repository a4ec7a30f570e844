"""Suffix-array dedup: repeated byte strings, by column-wise construction of a collection's BWT.

The strings of a bucket are the collection. A symbol is a block of bytes, so a
string gives one document for each phase of the block; every round puts the
next symbol, from the right, in front of each document's last suffix and
inserts the new suffixes into the Burrows-Wheeler transform and into the array
of longest common prefixes. Both lie in files that each round reads and
writes from front to back. At the end, neighbours with a common prefix of a
window's length are equal windows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, without
from .windows import Runs, Spec, merged, repeated_spans, with_spans

SPEC = Spec("byte", 200, 64)
_BLOCK = 64


class Column:
    """One array of the construction, kept in a file that each round reads and writes from front to back."""

    def __init__(self, folder: str, name: str, first: np.ndarray) -> None:
        self.file, self.dtype = open(f"{folder}/{name}", "w+b", buffering=0), first.dtype  # noqa: SIM115
        self.write(first)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(bytearray(self.file.read(self.size)), self.dtype)

    def write(self, values: np.ndarray) -> None:
        self.size = values.nbytes
        self.file.seek(0)
        left = memoryview(values).cast("B")
        while left:
            left = left[self.file.write(left) :]

    def close(self) -> None:
        self.file.close()


class RangeMinima:
    """Minima of many ranges [start, end) of an array: blocks, their running minima, and a sparse table of blocks."""

    def __init__(self, values: np.ndarray) -> None:
        n = -(-len(values) // _BLOCK)
        padded = np.full(n * _BLOCK, 255, np.uint8)
        padded[: len(values)] = values
        cells = padded.reshape(n, _BLOCK)
        self.flat = padded
        self.ahead = np.minimum.accumulate(cells, axis=1).reshape(-1)
        self.back = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [cells.min(axis=1)]
        width = 1
        while 2 * width <= n:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = end - 1
        a, b = start // _BLOCK, last // _BLOCK
        out = np.minimum(self.back[start], self.ahead[last])
        inner = np.flatnonzero(b > a + 1)
        if len(inner):
            lo, hi = a[inner] + 1, b[inner]
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            best = np.empty(len(inner), np.uint8)
            for k in np.unique(level):
                at = level == k
                best[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << int(k))])
            out[inner] = np.minimum(out[inner], best)
        same = np.flatnonzero(a == b)
        if len(same):
            width = (end - start)[same]
            heads = np.cumsum(width) - width
            at = np.repeat(start[same] - heads, width) + np.arange(int(width.sum()))
            out[same] = np.minimum.reduceat(self.flat[at], heads)
        return out


def _inserted(old: np.ndarray, stay: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(stay), old.dtype)
    out[stay] = old
    out[at] = new
    return out


def collection_windows(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, folder: str) -> np.ndarray:
    """Class of the window of `length` symbols at each place of a collection, -1 where its document is too short.

    symbols: 1 and up, 16 bits; documents lie end to end. Equal windows have
    equal classes. One symbol of each document is inserted a round, so there
    are as many rounds as the longest document has symbols.
    """
    m = len(starts)
    bwt = Column(folder, "bwt", np.zeros(m, np.uint16))
    lcp = Column(folder, "lcp", np.zeros(m, np.uint8))
    owner = Column(folder, "owner", np.full(m, -1, np.int32))
    rank = np.arange(m)  # where each document's last inserted suffix stands
    cap = min(length, 254)
    for depth in range(int(sizes.max()) if m else 0):
        live = np.flatnonzero(sizes > depth)
        where = starts[live] + sizes[live] - 1 - depth
        b, prefix = bwt.read(), lcp.read()
        b[rank[live]] = symbols[where]
        order = np.argsort(b, kind="stable")
        fresh = np.zeros(len(b), bool)
        fresh[rank[live]] = True
        at = np.flatnonzero(fresh[order])  # new suffixes in sorted order
        ends = m - len(live)  # documents that are through
        by_rank = np.argsort(rank[live])
        who = by_rank[np.searchsorted(rank[live], order[at], sorter=by_rank)]
        place = m + at - ends
        # common prefixes of each new suffix and of its successor with what stands before them
        touch = np.unique(np.concatenate((at, at + 1)))
        touch = touch[(touch < len(b)) & (touch > 0)]
        left, right = order[touch - 1], order[touch]
        same = (b[left] == b[right]) & (b[right] != 0)
        value = np.zeros(len(touch), np.uint8)
        if same.any():
            value[same] = np.minimum(RangeMinima(prefix).of(left[same] + 1, right[same] + 1) + 1, cap)
        by_order = np.zeros(len(b) + 1, np.uint8)
        by_order[touch] = value
        stay = np.ones(len(b) + len(live), bool)
        stay[place] = False
        prefix = _inserted(prefix, stay, place, by_order[at])
        after = np.setdiff1d(at + 1, at, assume_unique=True)  # successors that were there before
        after = after[after < len(b)]
        prefix[m + after - ends] = by_order[after]
        lcp.write(prefix)
        bwt.write(_inserted(b, stay, place, np.uint16(0)))
        owner.write(_inserted(owner.read(), stay, place, where[who].astype(np.int32)))
        rank = rank + np.searchsorted(place - np.arange(len(place)), rank, "right")  # insertions before each old place
        rank[live[who]] = place
    own, prefix = owner.read(), lcp.read()
    for column in (bwt, lcp, owner):
        column.close()
    classes = np.full(len(symbols), -1, np.int64)
    if m:
        real = own >= 0
        kind = np.cumsum(prefix < cap)
        classes[own[real]] = kind[real]
        ends = starts + sizes
        left = np.repeat(ends, sizes) - np.arange(len(symbols))
        classes[left < length] = -1
    return classes


def _coded(packed: list[bytes], n: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Documents of all phases as 16-bit symbols of `width` bytes: (symbols, starts, sizes, windows); None if too many differ."""
    flat = np.frombuffer(b"".join(packed), np.uint8).astype(np.uint64)
    block = flat
    for k in range(1, width):
        block = block[:-1] | flat[k:] << np.uint64(8 * k)
    base = np.cumsum([0, *map(len, packed)])[:-1]
    phase = np.arange(width)
    windows = np.maximum(0, (n[:, None] - 1 - phase[None, :]) // width + 1).reshape(-1)
    first = (base[:, None] + phase[None, :]).reshape(-1)
    sizes = np.where(windows > 0, windows + length // width - 1, 0)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(first, sizes) + width * (np.arange(int(sizes.sum())) - np.repeat(starts, sizes))
    kinds, codes = np.unique(block[at], return_inverse=True)
    if len(kinds) > 65_535:
        return None
    return (codes + 1).astype(np.uint16), starts, sizes, windows


def suffix_windows(length: int):  # noqa: ANN201
    """resolve() for windows of bytes: which windows of each string are found twice or more."""

    def resolve(packed: list[bytes], n: np.ndarray, cnt: np.ndarray, least: np.ndarray) -> list[Runs]:
        width = next(w for w in (8, 4, 2, 1) if length % w == 0 and (coded := _coded(packed, n, length, w)))
        symbols, starts, sizes, windows = coded
        with tempfile.TemporaryDirectory(prefix="quern-bwt-") as folder:
            classes = collection_windows(symbols, starts, sizes, length // width, folder)
        # back from phases to windows in the order of their strings
        of = np.repeat(np.arange(len(windows)), windows)
        step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        string, off = of // width, of % width + width * step
        first = np.cumsum(n) - n
        kind = np.empty(int(n.sum()), np.int64)
        kind[first[string] + off] = classes[starts[of] + step]
        owner = np.repeat(np.arange(len(n)), n)
        # a window counts once for each text that holds its string
        times = np.bincount(kind, weights=np.minimum(cnt, 2)[owner])
        hit = times[kind] > 1
        cuts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1]))))
        out: list[Runs] = [[] for _ in packed]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)], strict=True):
            if hit[a]:
                out[owner[a]].append((int(a - first[owner[a]]), b - a, 0))
        return out

    return resolve


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", spec: Spec = SPEC) -> DataFrame:
    """docs and n_bytes, n_removed, n_spans, kept: bytes covered by a string of `spec.length` bytes that starts anywhere else too are removed.

    kept is binary, the remaining bytes in order (a cut may split a
    character). Null texts have no bytes. Two equal rows repeat each other and
    lose all that is long enough. An empty table gives an empty result.
    Columns of docs stay, but for those of one of the four names, which are
    replaced (ValueError if it is the text's or the id's).
    """
    docs = without(docs, ["n_bytes", "n_removed", "n_spans", "kept"], text, id_col)
    spans = repeated_spans(docs, spec, suffix_windows(spec.length), across=False, text=text, id_col=id_col)
    joined = with_spans(docs, spans, text, id_col, "__spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text):
            n, gone, count, kept = [], [], [], []
            for t, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                raw = t.encode() if t else b""
                runs = merged(spans)
                edges = [0, *(x for r in runs for x in r), len(raw)]
                rest = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(raw))
                gone.append(len(raw) - len(rest))
                count.append(len(runs))
                kept.append(rest)
            cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, fields + ", n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
