"""Connected components of an edge table, without collecting edges, nodes or components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: So many edges are one partition's work: their rounds need no exchange.
PARTITION_EDGES = 100_000


def _large_star(edges: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = held(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return held(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge to another node.

    edges: a and b of one orderable type, any direction, loops and repeats
    allowed. Alternates large and small stars until the edges are stars and
    change no more; every round is written and read again, so executors may
    be lost. Partial minima are taken before each exchange and a hot node's
    rows are only joined, never gathered. Up to PARTITION_EDGES edges
    are one partition. No edges: an empty result.
    """
    held = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = tuple(held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = state
        few = (lambda df: df.coalesce(1)) if state[0] <= PARTITION_EDGES else (lambda df: df)
        nxt = written(_small_star(_large_star(held, few), few), "edges")
        drop_written(held)
        held = nxt
    raise RuntimeError("components did not settle")
