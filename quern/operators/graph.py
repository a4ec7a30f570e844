"""Entity graph retrieval: entities, co-occurrence, personalised PageRank."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import BLANK, blank_tokens
from ..plans.tables import bucketed, drop_bucketed, written
from .search import DECIMALS, dense_search, ranked


def entities(text: Column, include_single: bool = True, least: int = 2) -> Column:
    """Lower-cased runs of capitalised tokens that don't begin a sentence, each once, in order.

    Expressions only: tokens are folded with the run that is open; a run ends
    at any other token and at the sentence's end.
    """
    sents = F.split(F.trim(text), rf"(?<=[.!?]){BLANK}+")
    caps = lambda t: t.rlike(r"^[A-Z]") & (F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) >= least)
    clean = lambda t: F.regexp_replace(t, r"[.,;:!?\"']+$", "")
    # capitalised tokens keep their cleaned form, all others and the first of a sentence become a mark
    marked = lambda s: F.concat(F.transform(blank_tokens(s), lambda t, i: F.when((i > 0) & caps(t), clean(t)).otherwise("\x00")), F.array(F.lit("\x00")))
    flat = F.array_join(F.flatten(F.transform(sents, marked)), " ")
    runs = F.filter(F.transform(F.split(flat, "\x00"), lambda r: F.trim(r)), lambda r: r != "")
    if not include_single:
        runs = F.filter(runs, lambda r: F.contains(r, F.lit(" ")))
    return F.array_distinct(F.transform(runs, F.lower))


def build(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(mentions, edges): entity rows (entity, chunk_id) and weighted edges (src, dst, w), both ways.

    Pairs are made inside a chunk, whose entities a chunk's length bounds: give chunks, not whole documents.
    """
    listed = chunks.dropDuplicates([key]).select(F.col(key).alias("chunk_id"), entities(F.col(text)).alias("e"))
    mentions = listed.select(F.explode("e").alias("entity"), "chunk_id")
    pairs = listed.select(F.explode("e").alias("src"), "e").select("src", F.explode("e").alias("dst")).where("src <> dst")
    return mentions, pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def merged(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(mentions, edges) of two batches of chunks: weights add up, also where a chunk comes again."""
    edges = old[1].unionByName(new[1]).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return old[0].unionByName(new[0]).distinct(), edges


@dataclass
class Ranks:
    """rank (query_id, node, rank) of walks among nodes with edges and from lone seeds; lone (query_id, p): the share of a query's seeds without edges;
    whole (node, rank): what such a query has besides on every node, times its p, None if no query has any."""

    rank: DataFrame
    lone: DataFrame
    whole: DataFrame | None


def lone_shares(alpha: float, part: float, iterations: int) -> list[float]:
    """The mass that lone nodes give away in each round if all seeds are lone: a number for each round, the same for every query.

    Lone nodes have no edge in either direction, so they hold their restart and
    their part of what was given away one round before. part: lone of all nodes.
    """
    out = [1 - alpha]
    for _ in range(iterations - 1):
        out.append((1 - alpha) * (alpha + out[-1] * part))
    return out


def page_rank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, alpha: float = 0.5, iterations: int = 50, cut_every: int = 4, tolerance: float = 1e-12) -> Ranks:
    """Walks that restart at a query's seeds with probability alpha, `iterations` rounds or until no rank moves by more than tolerance.

    edges: src, dst, w, both ways; nodes: all nodes; seeds: query_id, node.
    Nodes without edges give their rank to all nodes evenly; seeds outside the
    graph are ignored and a query without seeds has no rows. Edges are dealt by
    their source once and written; each round moves ranks alone. What lone nodes
    give away is the same for every query but for the query's share of lone
    seeds: it walks along as one more query, not as a row for each node and query.
    """
    if iterations < 1 or not 0 < alpha <= 1:
        raise ValueError("iterations must be positive and alpha in (0, 1]")
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    step = bucketed(edges.join(total, "src").select("src", F.col("dst").alias("node"), (F.col("w") / F.col("total")).alias("share")), "steps", "src")
    own = written(seeds.join(nodes, "node", "left_semi").distinct(), "seeds")
    sources = step.select(F.col("src").alias("node"), F.lit(True).alias("linked")).distinct()
    weight = own.join(own.groupBy("query_id").agg((1.0 / F.count("*")).alias("p")), "query_id").join(sources, "node", "left")
    restart = written(weight.select("query_id", "node", "p", F.coalesce("linked", F.lit(False)).alias("linked")), "restart")
    lone = written(restart.where("NOT linked").groupBy("query_id").agg(F.sum("p").alias("p")), "lone-seeds")
    n, n_linked = nodes.count(), sources.count()
    given = lone_shares(alpha, (n - n_linked) / n, iterations) if not lone.isEmpty() else []
    plain = F.lit(False).alias("whole")
    rank = restart.select(plain, "query_id", "node", F.col("p").alias("rank"))
    evenly = nodes.select(F.lit(True).alias("whole"), F.lit(None).cast(seeds.schema["query_id"].dataType).alias("query_id"), "node")
    back = restart.select(plain, "query_id", "node", (alpha * F.col("p")).alias("r"), F.lit(0.0).alias("before"))
    for i in range(iterations):
        walk = rank.withColumnRenamed("node", "src").join(step, "src").select("whole", "query_id", "node", ((1 - alpha) * F.col("rank") * F.col("share")).alias("r"), F.lit(0.0).alias("before"))
        rows = walk.unionByName(back).unionByName(rank.select("whole", "query_id", "node", F.lit(0.0).alias("r"), F.col("rank").alias("before")))
        if given:
            rows = rows.unionByName(evenly.withColumns({"r": F.lit(given[i] / n), "before": F.lit(0.0)}))
        sums = rows.groupBy("whole", "query_id", "node").agg(F.sum("r").alias("rank"), F.sum("before").alias("before"))
        if (i + 1) % cut_every == 0 or i + 1 == iterations:
            held = written(sums, "rank")
            moved = held.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
            rank = held.select("whole", "query_id", "node", "rank")
            if moved is None or moved <= tolerance:
                break
        else:
            rank = sums.select("whole", "query_id", "node", "rank")
    drop_bucketed(step, edges.sparkSession)
    found = rank.where("rank > 0")
    return Ranks(found.where("NOT whole").select("query_id", "node", "rank"), lone, found.where("whole").select("node", "rank") if given else None)


def retrieve(queries: DataFrame, mentions: DataFrame, edges: DataFrame, k: int, iterations: int = 50) -> DataFrame:
    """Chunks by the summed rank of their entities; a query without a known entity has no hits.

    A query with seeds without edges ranks every chunk: those that its walk
    reaches are scored one by one, and of the others, whose order is one for all
    such queries, the best k can count.
    """
    mentions, edges = written(mentions, "mentions"), written(edges, "edges")
    nodes = written(mentions.select(F.col("entity").alias("node")).distinct(), "nodes")
    seeds = queries.select("query_id", F.explode(entities(F.col("query"))).alias("node"))
    found = page_rank(edges, nodes, seeds, iterations=iterations)
    held = mentions.withColumnRenamed("entity", "node")
    hits = found.rank.join(held, "node").groupBy("query_id", "chunk_id").agg(F.sum("rank").alias("score"))
    if found.whole is not None:
        every = written(found.whole.join(held, "node").groupBy("chunk_id").agg(F.sum("rank").alias("rank")), "whole-ranks")
        hits = hits.join(found.lone, "query_id", "left").join(every, "chunk_id", "left")
        hits = hits.select("query_id", "chunk_id", (F.col("score") + F.coalesce(F.col("p") * F.col("rank"), F.lit(0.0))).alias("score"))
        rest = dense_search(found.lone.select("query_id", F.array("p").alias("vec")), every.select("chunk_id", F.array("rank").alias("vec")), k, "dot")
        hits = hits.unionByName(rest.select("query_id", "chunk_id", "score")).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))  # the walk only adds
    return ranked(hits.where("score > 0"), k).withColumn("components", F.create_map(F.lit("ppr"), F.col("score")))


def mentions_of(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """The mentions of build(): (entity, chunk_id), each once."""
    listed = chunks.select(F.col(key).alias("chunk_id"), entities(F.col(text)).alias("e")).dropDuplicates(["chunk_id"])
    return listed.select(F.explode("e").alias("entity"), "chunk_id")


def numbered(df: DataFrame, column: str, number: str) -> DataFrame:
    """(column, number): the different values in their order, numbered from 0, as a table. Ranges of values are numbered side by side."""
    held = written(df.select(column).distinct().repartitionByRange(column).select(column, F.spark_partition_id().alias("part")), "values")
    begin, at = [], 0
    for r in held.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        begin.append((r["part"], at))
        at += r["n"]
    first = df.sparkSession.createDataFrame(begin, "part int, first long")
    order = Window.partitionBy("part").orderBy(column)
    return written(held.join(F.broadcast(first), "part").select(column, (F.col("first") + F.row_number().over(order) - 1).cast("int").alias(number)), "numbered")


class Mentions:
    """Who is named where, as arrays: the walk over entities that are named together goes by way of the chunks, so that it needs a number for each mention and none for each pair.

    chunk, node: numbers of a mention's chunk and entity. An edge weighs the
    number of chunks that name both ends: a node gets from each of its chunks
    what all that are named there give, but for itself.
    """

    #: Numbers that a task gathers at once, and that the ranks of the queries it walks for together may have.
    GATHERED, HELD = 1 << 20, 1 << 22

    def __init__(self, chunk: np.ndarray, node: np.ndarray) -> None:
        self.n_chunks, self.n = (int(x.max()) + 1 if len(x) else 0 for x in (chunk, node))
        order = np.lexsort((node, chunk))
        self.chunk, self.node = chunk[order].astype(np.int32), node[order].astype(np.int32)
        self.by_node = np.argsort(self.node, kind="stable").astype(np.int32)
        self.chunk_first = np.searchsorted(self.chunk, np.arange(self.n_chunks + 1))
        self.node_first = np.searchsorted(self.node[self.by_node], np.arange(self.n + 1))
        total = np.bincount(self.node, weights=(np.diff(self.chunk_first) - 1)[self.chunk], minlength=self.n)
        self.lone = total == 0
        self.share = np.divide(1.0, total, out=np.zeros(self.n), where=total > 0)[:, None]

    def _sums(self, first: np.ndarray, width: int, rows: Callable[[slice], np.ndarray]) -> np.ndarray:
        """Sums of rows(mentions) over the runs that begin at `first`, none of which is empty."""
        out = np.empty((len(first) - 1, width))
        step, a = max(1, self.GATHERED // max(1, width)), 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(first, first[a] + step, "right")) - 1)
            if first[b] - first[a] <= step:
                out[a:b] = np.add.reduceat(rows(slice(first[a], first[b])), first[a:b] - first[a], axis=0)
            else:  # one long run
                out[a] = sum(rows(slice(x, min(x + step, first[b]))).sum(axis=0) for x in range(first[a], first[b], step))
            a = b
        return out

    def per_chunk(self, x: np.ndarray) -> np.ndarray:
        return self._sums(self.chunk_first, x.shape[1], lambda s: x[self.node[s]])

    def walk(self, seeds: list[np.ndarray], alpha: float, iterations: int, tolerance: float) -> np.ndarray:
        """Ranks, a row for each node and a column for each query, after `iterations` rounds or once no rank moves by more than tolerance."""
        back = np.zeros((self.n, len(seeds)))
        for j, own in enumerate(seeds):
            back[own, j] = 1.0 / len(own)
        rank = back
        for _ in range(iterations):
            given = rank * self.share
            met = self.per_chunk(given)
            new = self._sums(self.node_first, len(seeds), lambda s: met[self.chunk[self.by_node[s]]] - given[self.node[self.by_node[s]]])
            new += rank[self.lone].sum(axis=0) / self.n
            new = (1 - alpha) * new + alpha * back
            moved = np.abs(new - rank).max()
            rank = new
            if moved <= tolerance:
                break
        return rank


def retrieve_mentioned(queries: DataFrame, mentions: DataFrame, k: int, alpha: float = 0.5, iterations: int = 50, tolerance: float = 1e-12) -> DataFrame:
    """What retrieve() gives over the graph that build() makes of the same chunks, without its edges.

    Mentions are numbered by Spark and go to every worker as two whole numbers
    each; queries are dealt over the tasks, and a task walks for some queries at
    once, so that its ranks stay within a bound.
    """
    if iterations < 1 or not 0 < alpha <= 1:
        raise ValueError("iterations must be positive and alpha in (0, 1]")
    spark = queries.sparkSession
    mentions = written(mentions, "mentions")
    nodes, chunks = numbered(mentions, "entity", "node"), numbered(mentions, "chunk_id", "chunk")
    pairs = mentions.join(nodes, "entity").join(chunks, "chunk_id").select("chunk", "node").toArrow()
    held = spark.sparkContext.broadcast(Mentions(*(pairs.column(c).to_numpy() for c in ("chunk", "node"))))
    asked = queries.select("query_id", F.explode(entities(F.col("query"))).alias("entity")).join(nodes, "entity").groupBy("query_id").agg(F.sort_array(F.collect_set("node")).alias("seeds"))
    kind = queries.schema["query_id"].dataType
    found = pa.schema([("query_id", to_arrow_type(kind)), ("chunk", pa.int32()), ("score", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = held.value
        some = max(1, Mentions.HELD // max(1, graph.n + graph.n_chunks))
        for batch in batches:
            for at in range(0, batch.num_rows, some):
                b = batch.slice(at, some)
                scores = graph.per_chunk(graph.walk([np.array(x) for x in b.column(1).to_pylist()], alpha, iterations, tolerance))
                rows: list[tuple] = []
                for j, name in enumerate(b.column(0).to_pylist()):
                    near = np.round(scores[:, j], DECIMALS)
                    at_least = np.partition(near, len(near) - k)[len(near) - k] if len(near) > k else -1.0
                    top = np.flatnonzero((near >= at_least) & (scores[:, j] > 0))
                    rows += [(name, int(c), float(scores[c, j])) for c in top[np.argsort(-near[top], kind="stable")[:k]]]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=found.names), preserve_index=False, schema=found)

    dealt = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits = dealt.mapInArrow(best, f"query_id {kind.simpleString()}, chunk int, score double")
    return ranked(hits.join(chunks, "chunk").select("query_id", "chunk_id", "score"), k).withColumn("components", F.create_map(F.lit("ppr"), F.col("score")))


def entities_of(text: str) -> list[str]:
    """The same entities for one text, for tests."""
    out: list[str] = []
    for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
        run: list[str] = []
        for i, token in enumerate([*sentence.split(), ""]):
            if i and re.match("[A-Z]", token) and len(re.sub("[^A-Za-z0-9]", "", token)) >= 2:
                run.append(re.sub(r"[.,;:!?\"']+$", "", token))
            elif run:
                out.append(" ".join(run).lower())
                run = []
    return list(pd.unique(pd.Series(out, dtype=object)))
