"""Join of intervals that overlap, as a join on cells: no pair is compared that shares no cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one cell of the left side that a task takes; a fuller cell is dealt over several.
CELL_ROWS = 20_000


def _level(start: Column, end: Column) -> Column:
    """The least power of two that is no shorter than the interval: it meets at most two cells of that size."""
    return F.greatest(F.lit(0), F.length(F.bin(end - start - 1))).cast("int")


def _sided(rows: DataFrame, keys: list[str], start: str, end: str, side: str, others: list[int]) -> DataFrame:
    """rows at each cell, of its own level and of the other side's coarser ones, that an interval meets; __own tells its own level.

    The row is held in the struct `side`; empty intervals and null bounds or keys meet nothing.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    held = rows.select(F.struct(*rows.columns).alias(side), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], s.alias(f"{side}_start"), e.alias(f"{side}_end"))
    held = held.where(F.expr(" AND ".join([f"{side}_start < {side}_end", *(f"__k{i} IS NOT NULL" for i in range(len(keys)))])))
    own = held.withColumn(f"{side}_level", _level(F.col(f"{side}_start"), F.col(f"{side}_end")))
    coarser = F.filter(F.lit(others).cast("array<int>"), lambda n: n > F.col(f"{side}_level"))
    levels = own.withColumn("__level", F.explode(F.concat(F.array(F.col(f"{side}_level")), coarser)))
    cell = lambda c: F.call_function("shiftright", c, F.col("__level"))
    return levels.withColumn("__cell", F.explode(F.sequence(cell(F.col(f"{side}_start")), cell(F.col(f"{side}_end") - 1))))


def _levels(rows: DataFrame, start: str, end: str) -> list[int]:
    """The levels that occur: 63 at most."""
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    return sorted(r[0] for r in rows.where(s < e).select(_level(s, e)).distinct().collect())


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """(left, right) structs of every pair of rows with equal keys whose half-open ranges overlap, each pair once.

    Ranges are integers [start, end). An interval lies in the one or two cells
    of the least size that is no shorter than itself, and meets longer ones in
    the cells of their size; so it is copied at most twice for each level that
    the other side has above its own, however long it is. A pair is put out in
    the cell that holds the later of the two starts. Cells with over cell_rows
    left rows are dealt over several tasks, with the right rows copied to each.
    Repeated rows pair like any; null keys or bounds and empty ranges pair with
    nothing.
    """
    a = _sided(left, keys, *left_range, "left", _levels(right, *right_range))
    b = _sided(right, keys, *right_range, "right", _levels(left, *left_range))
    on = [*(f"__k{i}" for i in range(len(keys))), "__level", "__cell"]
    full = a.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select(*on, F.ceil(F.col("n") / cell_rows).cast("int").alias("__deals"))
    deals = F.coalesce("__deals", F.lit(1))
    dealt = a.join(full, on, "left").withColumn("__deal", F.pmod(F.xxhash64("left", F.monotonically_increasing_id()), deals).cast("int")).drop("__deals")
    copied = b.join(full, on, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("__deals")
    met = dealt.join(copied, [*on, "__deal"]).where(
        (F.greatest("left_level", "right_level") == F.col("__level")) & (F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end"))
    )
    later = F.call_function("shiftright", F.greatest("left_start", "right_start"), F.col("__level"))
    return met.where(later == F.col("__cell")).select("left", "right")
