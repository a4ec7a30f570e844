"""Sharding by histogram sort, DataFrame functions only.

Rows are ordered by a 64-bit hash of the text and then by a hash of doc_id, so
that equal texts are neighbours. Splitters of the hash space are found by
counting the exact bytes below candidate boundaries on all partitions; each
round refines the probes around a target until the bytes below a boundary are
within tolerance. Only then are rows exchanged, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_crc32, written

#: One round looks at 2**BITS probes inside each open interval.
BITS = 10


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(16).cast("long")


def _cells(rows: DataFrame, key: str, shift: int) -> list[tuple[int, int, int, int]]:
    """Cell, exact bytes, least and greatest key of every occupied cell of key >> shift, in order."""
    cells = rows.groupBy(F.shiftright(F.col(key), shift).alias("cell")).agg(F.sum("size").alias("bytes"), F.min(key).alias("least"), F.max(key).alias("most"))
    return sorted((r["cell"], r["bytes"], r["least"], r["most"]) for r in cells.collect())


def _search(rows: DataFrame, key: str, wanted: dict[int, int], below: int, tolerance: float) -> dict[int, tuple[int, int, tuple[int, int] | None]]:
    """Refine one boundary for each wanted count of bytes over a signed 64-bit key.

    wanted: splitter -> bytes that shall lie below it; below: bytes under all
    of rows. Returns splitter -> (boundary, bytes below it, None), or, where
    one key value holds the target and its edges miss the tolerance, the
    nearer edge and (that value, bytes below the value). Of an open interval
    at most 2**BITS occupied cells, and one interval for each splitter, reach
    the driver.
    """
    done: dict[int, tuple[int, int, tuple[int, int] | None]] = {}
    open_at, shift = {s: (None, below, want) for s, want in wanted.items()}, 64
    while open_at:
        width, shift = shift, max(0, shift - BITS)
        inside = rows if width == 64 else rows.where(F.shiftright(F.col(key), width).isin(sorted({lo for lo, _, _ in open_at.values()})))
        cells = _cells(inside, key, shift)
        for s, (parent, seen, want) in list(open_at.items()):
            own = cells if parent is None else [c for c in cells if (c[0] << shift) >> width == parent]
            for cell, size, least, most in own:
                if seen + size > want:
                    break
                seen += size
            else:
                seen -= size
            end = min(most + 1, (1 << 63) - 1)
            edge, there = min(((least, seen), (end, seen + size)), key=lambda e: abs(e[1] - want))
            if abs(there - want) <= tolerance or least == most:
                done[s] = (edge, there, None if abs(there - want) <= tolerance else (least, seen))
                del open_at[s]
            else:
                open_at[s] = (cell, seen, want)
    return done


def _at_or_above(first: int, second: int | None) -> Column:
    above = F.col("k1") >= F.lit(first).cast("long")
    if second is None:
        return above
    return (F.col("k1") > F.lit(first).cast("long")) | ((F.col("k1") == F.lit(first).cast("long")) & (F.col("k2") >= F.lit(second).cast("long")))


def shard(docs: DataFrame, shards: int = 40, text: str = "text", id_col: str = "doc_id", tolerance: float = 0.002, group_tolerance: float = 0.01, salt_rows: int = 50_000) -> DataFrame:
    """Add shard (0 to shards-1, near equal bytes) and slot (gapless from 0 in its shard).

    The law is `bytes`: each boundary is within `tolerance` of a shard's even
    share, or as near as one row allows. Equal texts share a shard unless both
    ends of their group miss a boundary's place by more than
    `group_tolerance` of a share; then the group is cut by a hash of id_col. All columns of docs are kept; k1, k2, size, shard
    and slot are added, and replace columns of docs of these names (not the
    text's or the id's: ValueError). Null texts count 16 bytes; null ids hash
    like any value; equal rows are told apart by nothing and may stand in any
    order, each with its own slot. An empty table gives an empty result.
    """
    added = ["k1", "k2", "size", "shard", "slot"]
    if {text, id_col} & {*added}:
        raise ValueError(f"the text and the id can't be named one of {added}")
    docs = docs.drop(*added)
    keyed = docs.withColumns({
        "k1": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "k2": F.xxhash64(F.col(id_col)),
        "size": row_size(text),
    })
    rows = written(keyed.select("k1", "k2", "size"), "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    bytes_all, n_rows = int(total["b"]), int(total["n"])
    share = bytes_all / shards
    wanted = {s: round(share * s) for s in range(1, shards)} if n_rows else {}
    found = _search(rows, "k1", wanted, 0, tolerance * share)
    splitters: dict[int, tuple[int, int | None]] = {s: (k, None) for s, (k, _, _) in found.items()}
    wide = {s: at for s, (_, there, at) in found.items() if at and abs(there - wanted[s]) > group_tolerance * share}
    for value, under in sorted(set(wide.values())):  # a group of equal texts that must be cut
        group = rows.where(F.col("k1") == F.lit(value).cast("long"))
        cuts = _search(group, "k2", {s: wanted[s] for s, at in wide.items() if at[0] == value}, under, tolerance * share)
        splitters |= {s: (value, k) for s, (k, _, _) in cuts.items()}
    where = [_at_or_above(*splitters[s]) for s in sorted(splitters)]
    index = reduce(lambda a, b: a + b, [F.when(w, 1).otherwise(0) for w in where], F.lit(0)).cast("int")
    placed = keyed.withColumn("shard", index)
    # slots: rows of a shard are numbered in salted runs, whose starts come from exact counts
    salts = max(1, min(4096, -(-n_rows // (shards * salt_rows))))
    salt = F.pmod(F.xxhash64("k1", "k2"), F.lit(salts)).cast("int")  # of text and id: one id, or one text, is no hot run
    counts = rows.withColumn("shard", index).groupBy("shard", salt.alias("salt")).agg(F.count("*").alias("n")).collect()
    starts: dict[tuple[int, int], int] = {}
    at: dict[int, int] = {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["salt"])):
        starts[r["shard"], r["salt"]] = at.get(r["shard"], 0)
        at[r["shard"]] = at.get(r["shard"], 0) + r["n"]
    spark = docs.sparkSession
    base = spark.createDataFrame([(s, t, b) for (s, t), b in starts.items()], "shard int, salt int, slot_base long")
    run = Window.partitionBy("shard", "salt").orderBy("k1", "k2")
    numbered = placed.withColumn("salt", salt).withColumn("in_run", F.row_number().over(run))
    return (
        numbered.join(F.broadcast(base), ["shard", "salt"])  # shards * 4096 rows at most
        .withColumn("slot", F.col("slot_base") + F.col("in_run") - F.lit(1).cast("long"))
        .drop("slot_base", "in_run", "salt")
    )


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The contract's columns for documents, law `bytes`."""
    slim = docs.select("doc_id", "text", text_crc32("text").alias("text_crc32"))
    placed = shard(slim, shards)  # the text itself is pruned before the exchange
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
