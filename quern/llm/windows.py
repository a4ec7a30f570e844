"""Exact repeats of fixed-length windows over a whole corpus.

A window's anchor is its least m-gram by hash, the leftmost of equals. Windows
that follow each other and share an anchor form one super-window, whose units
travel as one packed string to the bucket of its anchor's hash; equal windows
have equal anchors and so meet in one bucket. Only super-windows whose anchor
occurs elsewhere go on; equal ones are counted once, and only buckets with
different strings have their texts fetched and compared, by the operator's own
method (`resolve`).

Digests are 64 bits of anchor and 64 of content, both must agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, split_words, text_blocks, written

#: Buckets with more different strings are resolved window by window, over all tasks.
MOST_STRINGS = 8192
#: Strings that one call of resolve() gets; a bucket is never cut.
CHUNK_STRINGS = 400
_SEGMENT = 1 << 22
_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Spec:
    """unit: byte or word; length: units of a window; gram: units of an anchor."""

    unit: str
    length: int
    gram: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Block:
    """Units of several texts, laid end to end."""

    def __init__(self, texts: list[str | None], unit: str) -> None:
        if unit == "byte":
            parts = [t.encode() if t else b"" for t in texts]
            self.buffer = b"".join(parts)
            self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            self.values = _BYTE_VALUES[np.frombuffer(self.buffer, np.uint8)]
            self.begin = self.end = None
        else:
            words = [split_words(t) for t in texts]
            self.sizes = np.fromiter(map(len, words), np.int64, len(words))
            flat = [w for ws in words for w in ws]
            self.values = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
            self.buffer = b" ".join(flat)
            ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)
            self.end = ends - 1
            self.begin = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(flat) else ends
        self.starts = np.cumsum(self.sizes) - self.sizes

    def spans(self, first: np.ndarray, after: np.ndarray) -> list[bytes]:
        """Packed strings of the unit ranges [first, after)."""
        if self.begin is not None:
            first, after = self.begin[first], self.end[after - 1]
        buffer = self.buffer
        return [buffer[a:b] for a, b in zip(first.tolist(), after.tolist(), strict=True)]


def super_windows(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first unit in the block, windows, anchor hash) of every super-window, texts laid end to end."""
    length, gram = spec.length, spec.gram
    total = len(values) - length + 1
    empty = np.zeros(0, np.int64)
    if total <= 0:
        return empty, empty, empty, empty.astype(np.uint64)
    edge = np.zeros(len(values) + 1, np.int64)
    long = sizes >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(edge[:total]) > 0
    firsts, counts, hashes = [], [], []
    for at in range(0, total, _SEGMENT):
        upto = min(total, at + _SEGMENT)
        part = values[at : upto + length - 1]
        h, width, power = part, 1, np.uint64(0xD6E8FEB86659FD93)
        while width < gram:
            step = min(width, gram - width)
            if step == width:
                h = h[:-width] * power + h[width:]
                power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
            else:  # gram is no power of two: overlap the last step
                h = _mixed(h[:-step] * power + h[step:])
            width += step
        h = _mixed(h)
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        span, width = length - gram + 1, 1
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        ok = valid[at:upto]
        cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1]))))
        ends = np.append(cut[1:], len(place))
        keep = ok[cut]
        firsts.append(cut[keep] + at)
        counts.append(ends[keep] - cut[keep])
        hashes.append(h[place[cut[keep]]])
    first = np.concatenate(firsts)
    return np.searchsorted(starts[long], first, "right") - 1 if long.all() else np.flatnonzero(long)[np.searchsorted(starts[long], first, "right") - 1], first, np.concatenate(counts), np.concatenate(hashes)


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """id and text hash name a row; rows with equal ids and texts share their result."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), text_key(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def cut_super_windows(keyed: DataFrame, spec: Spec) -> DataFrame:
    """(doc, th, first, n, h, c): all super-windows of all texts; c is the digest of the packed string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in text_blocks(batches, "text"):
            block = Block(b.column(2).to_pylist(), spec.unit)
            text, first, n, h = super_windows(block.values, block.starts, block.sizes, spec)
            c = np.fromiter(map(digest, block.spans(first, first + n + spec.length - 1)), np.uint64, len(first))
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array((first - block.starts[text]).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))],
                names=["doc", "th", "first", "n", "h", "c"],
            )

    return keyed.mapInArrow(run, "doc long, th long, first int, n short, h long, c long")


#: What resolve() returns for each string: runs (first window, windows, least id of the texts that hold them), or windows found twice.
Runs = list[tuple[int, int, int]]
Resolve = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], list[Runs]]


def _resolved(strings: DataFrame, resolve: Resolve) -> DataFrame:
    """Run resolve over whole buckets, several small ones at once; (h, c, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in ("h", "c", "n", "cnt", "least", "packed")}

        def flush(upto: int) -> pa.RecordBatch:
            now = {k: v[:upto] for k, v in held.items()}
            for v in held.values():
                del v[:upto]
            runs = resolve(now["packed"], np.array(now["n"], np.int64), np.array(now["cnt"], np.int64), np.array(now["least"], np.int64))
            kind = pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32()), ("least", pa.int64())]))
            rows = [[{"off": o, "len": k, "least": m} for o, k, m in r] for r in runs]
            return pa.RecordBatch.from_arrays([pa.array(now["h"], pa.int64()), pa.array(now["c"], pa.int64()), pa.array(rows, kind)], names=["h", "c", "runs"])

        for b in batches:
            for name in held:
                held[name] += b.column(b.schema.get_field_index(name)).to_pylist()
            while len(hs := held["h"]) > CHUNK_STRINGS:
                cut = CHUNK_STRINGS
                while cut < len(hs) and hs[cut] == hs[cut - 1]:
                    cut += 1
                if cut == len(hs):  # the last bucket may go on in the next batch
                    break
                yield flush(cut)
        if held["h"]:
            yield flush(len(held["h"]))

    ordered = strings.repartition("h").sortWithinPartitions("h")
    return ordered.select("h", "c", "n", "cnt", "least", "packed").mapInArrow(run, "h long, c long, runs array<struct<off:int,len:int,least:long>>")


def _fetch(keyed: DataFrame, wanted: DataFrame, spec: Spec, single: bool) -> DataFrame:
    """Packed strings of wanted (h, c, doc, th, first, n, cnt, least); single: digests of each of their windows instead."""
    lists = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "c", "first", "n", "cnt", "least")).alias("want"))
    # rows with equal id and text are one here
    joined = keyed.join(lists, ["doc", "th"]).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, other = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for b in text_blocks(batches, "text"):
            block = Block(b.column(0).to_pylist(), spec.unit)
            lists = b.column(1)
            per = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(b.num_rows), per)
            flat = lists.flatten()
            col = {k: flat.field(k).to_numpy() for k in ("h", "c", "first", "n", "cnt", "least")}
            first = block.starts[rows] + col["first"]
            n = col["n"].astype(np.int64)
            if not single:
                packed = block.spans(first, first + n + spec.length - 1)
                yield pa.RecordBatch.from_arrays([pa.array(col[k]) for k in ("h", "c", "n", "cnt", "least")] + [pa.array(packed, pa.binary())], names=["h", "c", "n", "cnt", "least", "packed"])
                continue
            of = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            packed = block.spans(first[of] + off, first[of] + off + spec.length)
            w1 = np.fromiter(map(digest, packed), np.uint64, len(packed)).view(np.int64)
            w2 = np.fromiter(map(other, packed), np.uint64, len(packed)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(col[k][of]) for k in ("h", "c", "cnt", "least")] + [pa.array(off.astype(np.int32)), pa.array(w1), pa.array(w2)], names=["h", "c", "cnt", "least", "off", "w1", "w2"])

    kind = "h long, c long, cnt long, least long, off int, w1 long, w2 long" if single else "h long, c long, n short, cnt long, least long, packed binary"
    return joined.mapInArrow(run, kind)


def repeated_spans(docs: DataFrame, spec: Spec, resolve: Resolve, across: bool, text: str = "text", id_col: str = "doc_id", most_strings: int = MOST_STRINGS) -> DataFrame:
    """(doc, th, spans): for each row that has some, its covered unit ranges, sorted and apart.

    across=False: units covered by a window that occurs anywhere else.
    across=True: units covered by a window that occurs in a row of smaller id.
    """
    keyed = _keyed(docs, text, id_col)
    cut = written(cut_super_windows(keyed, spec), "super-windows")
    if across:
        shared = cut.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("h")
    else:
        shared = cut.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    # counts are written before they are joined: with a plain exchange on either side Spark can split a hot anchor's rows
    shared = written(shared, "shared-anchors")
    again = written(cut.join(shared, "h", "left_semi"), "shared-super-windows")
    drop_written(cut)
    strings = written(again.groupBy("h", "c").agg(F.count("*").alias("cnt"), F.min(F.struct("doc", "th", "first", "n")).alias("rep")), "strings")
    sizes = written(strings.groupBy("h").agg(F.count("*").alias("different")), "anchor-sizes")
    contents = written(strings.join(sizes, "h").select("h", "c", "cnt", "different", "rep.*").withColumn("least", F.col("doc")), "contents")
    for t in (shared, strings, sizes):
        drop_written(t)
    one_run = F.array(F.struct(F.lit(0).alias("off"), F.col("n").cast("int").alias("len"), F.col("least")))
    alone = contents.where("different = 1")
    alone = (alone if across else alone.where("cnt > 1")).select("h", "c", one_run.alias("runs"))
    strings = _fetch(keyed, contents.where(f"different between 2 and {most_strings}"), spec, single=False)
    verdicts = alone.unionByName(_resolved(strings, resolve))
    hot = contents.where(f"different > {most_strings}")
    if not hot.isEmpty():
        each = written(_fetch(keyed, hot, spec, single=True), "hot-windows")
        known = each.groupBy("w1", "w2").agg(F.sum("cnt").alias("all"), F.min("least").alias("least_all"))
        known = known if across else known.where("all > 1")
        found = each.join(known, ["w1", "w2"]).groupBy("h", "c").agg(F.collect_list(F.struct("off", F.lit(1).alias("len"), F.col("least_all").alias("least"))).alias("runs"))
        verdicts = verdicts.unionByName(found)
    verdicts = written(verdicts.where(F.size("runs") > 0), "verdicts")
    each = again.join(verdicts, ["h", "c"]).select("doc", "th", "first", F.explode("runs").alias("r"))
    if across:
        each = each.where("r.least < doc")
    begin = (F.col("first") + F.col("r.off")).cast("int")
    runs = each.select("doc", "th", begin.alias("b"), (begin + F.col("r.len") + F.lit(spec.length - 1)).cast("int").alias("e"))
    return runs.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("b", "e"))).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, text: str = "text", id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """docs with their spans (null where there are none); all columns of docs are kept."""
    key = spans.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("spans").alias(spans_col))
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col("__doc")) & (text_key(text) == F.col("__th"))
    return docs.join(key, same, "left").drop("__doc", "__th")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch or overlap joined."""
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["b"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["e"])
        else:
            out.append([s["b"], s["e"]])
    return [(b, e) for b, e in out]
