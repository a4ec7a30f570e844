"""Embedding near-duplicates by NN-descent.

Every vector keeps a list of its best neighbours. Lists start from groups of
equal sign patterns under random hyperplanes and are refined by joining the
neighbours of each vector with each other, until a round finds no new pair at
the threshold. Equal vectors are one node with a weight. Lists may be full of
a tight group's own members and lose the links that lead out of it, so that
at the end every vector is compared with every other, tile against tile: this
counts all links and finds those between the components that the lists gave,
which are joined. The lists' components only keep the links that it puts out
few: the result does not depend on how good the lists are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, grouped, written
from .components import components

THRESHOLD = 0.9
NEIGHBOURS = 8
TREES = 6
LEAF = 64
BLOCK = 512
#: Vectors of a tile of the exact comparison: an eighth of all within these bounds.
LEAST_TILE, MOST_TILE = 2048, 32768
#: Rounds of refining; the exact comparison finds what they leave, so they bound only the effort.
MOST_ROUNDS = 6


def prepare(vectors: DataFrame, vec: str, id_col: str) -> DataFrame:
    """(node, id, dim, v64, v32): unit vectors as binary; null, zero and non-finite ones have dim 0 and no vector."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, v64, v32 = [], [], []
            for row in b.column(2).to_pylist():
                x = None if row is None or None in row else np.array(row, np.float64)
                norm = 0.0 if x is None or not len(x) else float(np.sqrt((x * x).sum()))
                if not math.isfinite(norm) or norm == 0.0:
                    peak = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.abs(x).max())
                    if peak:  # squares over- or underflow: scale first
                        x = x / peak
                        norm = float(np.sqrt((x * x).sum()))
                    else:
                        norm = 0.0
                ok = norm > 0
                dim.append(len(x) if ok else 0)
                v64.append((x / norm).tobytes() if ok else None)
                v32.append((x / norm).astype(np.float32).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dim, pa.int32()), pa.array(v64, pa.binary()), pa.array(v32, pa.binary())], names=["node", "id", "dim", "v64", "v32"])

    return vectors.select(F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("id"), F.col(vec).alias("v")).mapInArrow(run, f"node long, id {kind}, dim int, v64 binary, v32 binary")


def _matrix(packed: list[bytes], dtype: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype).reshape(len(packed), -1)


def leaf_lists(nodes: DataFrame, n: int, k: int) -> DataFrame:
    """First candidates (node, nbr, sim): the best k of each vector's group, in each of TREES sets of hyperplanes."""
    bits = max(1, math.ceil(math.log2(max(2, n / (LEAF / 2)))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, dim, packed = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = _matrix([packed[i] for i in at])
                for tree in range(TREES):
                    planes = np.random.default_rng([7, tree, int(d)]).standard_normal((bits, int(d))).astype(np.float32)
                    pattern = ((x @ planes.T) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    leaf = (np.int64(int(d) % 1024) << 53) | (np.int64(tree) << 48) | pattern
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(leaf)], names=["node", "leaf"])

    leaves = written(nodes.select("node", "dim", "v32").mapInArrow(sign, "node long, leaf long"), "leaves")
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / LEAF)  # a crowded leaf is dealt into parts
    dealt = leaves.join(sizes, "leaf").select("node", F.xxhash64("leaf", F.pmod(F.xxhash64("node", "leaf"), parts)).alias("part"))

    def best(_: int, rows: dict[str, list]) -> Iterator[tuple]:
        node = np.array(rows["node"], np.int64)
        for at in range(0, len(node), 4 * LEAF):
            part = node[at : at + 4 * LEAF]
            if len(part) < 2:
                continue
            x = _matrix(rows["v32"][at : at + 4 * LEAF])
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            m = min(k, len(part) - 1)
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            yield np.repeat(part, m), part[top].reshape(-1), np.take_along_axis(sims, top, axis=1).reshape(-1)

    return grouped(dealt.join(nodes.select("node", "v32"), "node"), "part", ["node", "v32"], best, "node long, nbr long, sim float", ["node", "nbr", "sim"])


def top_lists(candidates: DataFrame, k: int) -> DataFrame:
    """(node, nbrs): the k best different neighbours of each node, best first."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("sim", "nbr")), asc=False), 1, k)
    one = candidates.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    return one.groupBy("node").agg(best.alias("nbrs"))


def refine(nodes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours: candidates (node, nbr, sim) that beat the last entry of the node's list.

    Every node joins the members of its own list and of a hashed choice of
    2k nodes that list it.
    """
    pairs = graph.select("node", F.explode("nbrs").alias("n")).select("node", F.col("n.nbr").alias("nbr"))
    chosen = Window.partitionBy("hub").orderBy(F.xxhash64("hub", "member"))
    back = pairs.select(F.col("nbr").alias("hub"), F.col("node").alias("member")).withColumn("r", F.row_number().over(chosen)).where(f"r <= {2 * k}").drop("r")
    around = pairs.select(F.col("node").alias("hub"), F.col("nbr").alias("member")).unionByName(back).distinct()
    least = graph.select(F.col("node").alias("member"), F.when(F.size("nbrs") < k, F.lit(-2.0)).otherwise(F.element_at("nbrs", -1)["sim"]).cast("float").alias("least"))
    rows = around.join(nodes.select(F.col("node").alias("member"), "v32").join(least, "member", "left"), "member")

    def local(_: int, rows: dict[str, list]) -> Iterator[tuple]:
        if len(rows["member"]) < 2:
            return
        member, x = np.array(rows["member"], np.int64), _matrix(rows["v32"])
        least = np.array([-2.0 if v is None else v for v in rows["least"]], np.float32)
        sims = x @ x.T
        np.fill_diagonal(sims, -3)
        i, j = np.nonzero(sims > least[:, None] + 1e-6)
        yield member[i], member[j], sims[i, j]

    return grouped(rows, "hub", ["member", "v32", "least"], local, "node long, nbr long, sim float", ["node", "nbr", "sim"])


def links_of(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Pairs of list entries whose cosine, in double precision, is at the threshold."""
    near = graph.select("node", F.explode("nbrs").alias("n")).where(F.col("n.sim") >= threshold - 1e-4)
    pairs = near.select(F.least("node", "n.nbr").alias("a"), F.greatest("node", "n.nbr").alias("b")).distinct()
    x = nodes.select(F.col("node").alias("a"), F.col("v64").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.col("v64").alias("y"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, v = b.column(2).to_pylist(), b.column(3).to_pylist()
                cos = np.array([np.frombuffer(p) @ np.frombuffer(q) if len(p) == len(q) else -1.0 for p, q in zip(u, v, strict=True)])
                at = pa.array(np.flatnonzero(cos >= threshold))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")


def exact_links(nodes: DataFrame, found: DataFrame, n: int, threshold: float) -> DataFrame:
    """Every vector against every other, tile against tile: (node, n_links, other).

    other -1: the links of node counted in one tile, equal rows included. Else
    a link node-other between two components of found, one for each pair of
    components in a tile. No link is left out: work grows with the square of
    the number of different vectors, output with vectors x tiles.
    """
    tile = min(MOST_TILE, max(LEAST_TILE, n // 8))
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    members = nodes.select("node", "dim", "weight").join(found, "node", "left").join(F.broadcast(sizes), "dim").withColumns({"component": F.coalesce("component", "node"), "block": F.pmod(F.xxhash64("node"), "blocks").cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    columns = ["node", "component", "weight", "dim", "block", "i", "j"]
    rows = paired.select(*columns, F.xxhash64("dim", "i", "j").alias("grp")).join(nodes.select("node", "v64"), "node")

    def compare(_: int, rows: dict[str, list]) -> Iterator[tuple]:
        node, comp, weight, dim, block, i, j = (np.array(rows[c], np.int64) for c in columns)
        for d, p, q in sorted(set(zip(dim.tolist(), i.tolist(), j.tolist(), strict=True))):  # one, unless hashes meet
            at = np.flatnonzero((dim == d) & (i == p) & (j == q))
            left, right = at[block[at] == p], at[block[at] == q]
            if not len(left) or not len(right):
                continue
            y = _matrix([rows["v64"][r] for r in right], np.float64)
            back = np.zeros(len(right), np.int64)
            for s in range(0, len(left), BLOCK):
                part = left[s : s + BLOCK]
                hit = _matrix([rows["v64"][r] for r in part], np.float64) @ y.T >= threshold
                if p == q:
                    hit[np.arange(len(part)), s + np.arange(len(part))] = False
                counts = hit @ weight[right] + (weight[part] - 1 if p == q else 0)
                yield node[part], counts, np.full(len(part), -1, np.int64)
                if p != q:
                    back += weight[part] @ hit
                u, v = np.nonzero(hit)
                apart = comp[part][u] != comp[right][v]
                u, v = part[u[apart]], right[v[apart]]
                _, first = np.unique(np.stack((comp[u], comp[v])), axis=1, return_index=True)
                yield node[u[first]], np.zeros(len(first), np.int64), node[v[first]]
            if p != q:
                yield node[right], back, np.full(len(right), -1, np.int64)

    return grouped(rows, "grp", [*columns, "v64"], compare, "node long, n_links long, other long", ["node", "n_links", "other"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec: str = "embedding", id_col: str = "vec_id", k: int = NEIGHBOURS) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of vectors.

    Null, zero and non-finite vectors, and vectors of different lengths, link
    with nothing; equal rows link with each other. kept: the id names its own
    component. A null id names a component only if all its ids are null. An
    empty table gives an empty result. Labels and other columns are not read.
    """
    all_rows = written(prepare(vectors, vec, id_col), "vectors")
    nodes = written(all_rows.where("dim > 0").groupBy("dim", "v64", "v32").agg(F.min("node").alias("node"), F.count("*").alias("weight")), "nodes")  # equal vectors are one
    n = nodes.count()
    graph = written(top_lists(leaf_lists(nodes, n, k), k), "lists")
    at_threshold = lambda g: g.agg(F.coalesce(F.sum(F.size(F.filter("nbrs", lambda e: e["sim"] >= threshold - 1e-4))), F.lit(0))).first()[0]
    known = at_threshold(graph)
    for _ in range(MOST_ROUNDS):
        flat = graph.select("node", F.explode("nbrs").alias("n")).select("node", "n.nbr", "n.sim")
        nxt = written(top_lists(flat.unionByName(refine(nodes, graph, k)), k), "lists")
        drop_written(graph)
        graph, before, known = nxt, known, at_threshold(nxt)
        if known <= before * 1.002:
            break
    found = components(links_of(nodes, graph, threshold))
    exact = written(exact_links(nodes, found, n, threshold), "links")
    bridges = exact.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if not bridges.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(bridges))
    counts = exact.where("other < 0").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    one = nodes.select("dim", "v64", F.col("node").alias("first"))
    rows = all_rows.join(one, ["dim", "v64"], "left").select(F.coalesce("first", "node").alias("node"), "id")
    named = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return (
        named.join(least, "component").join(counts, "node", "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
