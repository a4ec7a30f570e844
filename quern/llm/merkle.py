"""Merkle manifest of a dataset, one tree a group and one over the groups' roots, in an external node store.

Leaves are sorted once and cut into runs of RUN consecutive nodes of a group.
The store holds the nodes of every level as Parquet, partitioned by level, a
row for each run. A tier reads the nodes that the tier before put at the top
of its runs, and writes the next LEVELS levels. Proofs are extracted by
coordinate, from the top down: a run's rows of its own levels are merged with
the path that its top node has in the tier above. Nothing but the number of
tiers reaches the driver, and no row holds more than a run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, shared_folder, written

#: Levels of a tier. A run is 2**LEVELS consecutive nodes of one group.
LEVELS = 10
_NODES = "g string, run long, n long, step int, nodes array<string>"
_PATH = "array<struct<sibling:string,left:boolean>>"


def field(value: Column) -> Column:
    """A field of a leaf's text: `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def group_key(column: str) -> Column:
    """A key that is never null and sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], spent: list[DataFrame]) -> DataFrame:
    """rows with pos, gapless from 0 in each group `g` by `order`, and n, the group's number of rows.

    spent gets the tables that the result reads, for drop_written() afterwards.

    One range exchange sorts rows of any group over all tasks; a row's place is
    its place in its task's run of the group plus the lengths of the group's
    earlier runs. Rows that are equal in `order` are dealt by their input row,
    so that repeats of one row are no hot key.
    """
    cut = rows.withColumn("__in", F.monotonically_increasing_id())
    keys = ["g", *order, "__in"]
    placed = cut.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__in").withColumns({
        "__run": F.spark_partition_id(),
        "__at": F.monotonically_increasing_id(),
    })
    held = written(placed, "merkle-sorted")
    runs = held.groupBy("g", "__run").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    of = Window.partitionBy("g").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that holds some of the group
    starts = runs.withColumns({
        "__start": F.coalesce(F.sum("__rows").over(of), F.lit(0)) - F.col("__first"),
        "n": F.sum("__rows").over(Window.partitionBy("g")),
    }).drop("__first", "__rows")
    starts = written(starts, "merkle-starts")
    spent += [held, starts]
    return held.join(starts, ["g", "__run"]).withColumn("pos", F.col("__start") + F.col("__at")).drop("__run", "__at", "__start")


def _parents(nodes: Column) -> Column:
    """Digests of every two consecutive nodes; a last one alone is digested alone."""
    pair = lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int")), pair)


def _steps(n: Column) -> Column:
    """Levels above a run: LEVELS, or, in a group of one run, as many as its nodes need to become one."""
    return F.when(n > (1 << LEVELS), LEVELS).when(n == 1, 0).otherwise(F.length(F.bin(n - 1)).cast("int"))


@dataclass
class Forest:
    """A tree for each group: the store's path, its runs of leaves, (g, root, n), and the number of tiers."""

    store: str
    runs: DataFrame
    roots: DataFrame
    tiers: int


def _stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(f"{_NODES}, tier int, level int").parquet(store)  # an empty store has no file to tell


def build(rows: DataFrame, leaf: str, kept: list[str]) -> Forest:
    """Trees over rows of (g, pos, n, leaf), as numbered() gives them; the runs keep the columns `kept`.

    Each tier is written before the next reads it. A group ends in the tier in
    which it has one run.
    """
    spark = rows.sparkSession
    store = f"{shared_folder(spark)}/quern-tables/merkle-store-{uuid.uuid4().hex}"
    in_run = F.shiftright("pos", LEVELS).alias("run")
    member = F.struct(F.col("pos"), F.col(leaf).alias("node"), *kept)
    runs = written(rows.groupBy("g", in_run, "n").agg(F.array_sort(F.collect_list(member)).alias("rows")), "merkle-runs")  # 2**LEVELS rows at most
    bottom, tier = runs.select("g", "run", "n", F.col("rows.node").alias("nodes")), 0
    while True:
        grown = F.aggregate(
            F.sequence(F.lit(1), _steps(F.col("n"))), F.array(F.col("nodes")), lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))),
        )
        levels = F.when(_steps(F.col("n")) == 0, F.array(F.col("nodes"))).otherwise(grown)
        out = bottom.select("g", "run", "n", F.posexplode(levels).alias("step", "nodes")).withColumn("level", F.col("step") + F.lit(tier * LEVELS))
        path = f"{store}/tier={tier}"
        out.write.option("compression", "zstd").partitionBy("level").parquet(path)
        if spark.read.schema(_NODES).parquet(path).where(F.col("n") > (1 << LEVELS)).isEmpty():
            break
        above = spark.read.schema(_NODES).parquet(f"{path}/level={(tier + 1) * LEVELS}").where(F.col("n") > (1 << LEVELS))
        tops = above.select("g", F.col("run").alias("pos"), (F.shiftright(F.col("n") - 1, LEVELS) + 1).alias("n"), F.get("nodes", F.lit(0)).alias("node"))
        bottom = tops.groupBy("g", in_run, "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("rows")).select("g", "run", "n", F.col("rows.node").alias("nodes"))
        tier += 1
    nodes = _stored(spark, store)
    roots = nodes.where((F.col("n") <= (1 << LEVELS)) & (F.col("step") == _steps(F.col("n")))).select("g", F.get("nodes", F.lit(0)).alias("root"), F.col("tier"))
    return Forest(store, runs, roots, tier + 1)


def _own_path(levels: Column, at: Column) -> Column:
    """Siblings of the run's node `at` below the run's top, from its own level up."""
    def entry(level: Column, i: Column) -> Column:
        place = F.call_function("shiftright", at, i)
        return F.struct(F.get(level, place.bitwiseXOR(1)).alias("sibling"), (place.bitwiseAND(1) == 1).alias("left"))

    below = F.slice(levels, 1, F.size(levels) - 1)
    return F.transform(below, entry)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """(g, run, n, rows, levels, path) of the runs of leaves: path is that of the run's top node up to the last root.

    above: (g, path) of each group's root. From the last tier down, the levels
    of a run are merged by its coordinate and each node gets its place's path.
    """
    spark = above.sparkSession
    store = _stored(spark, forest.store)
    ends = written(forest.roots.join(above, "g").select("g", "tier", "path"), "merkle-ends")
    upper: DataFrame | None = None
    for tier in reversed(range(forest.tiers)):
        rows = store.where(F.col("tier") == tier)
        runs = rows.groupBy("g", "run", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "nodes"))), lambda x: x["nodes"]).alias("levels"))  # LEVELS + 1 rows
        tops = ends.where(F.col("tier") == tier).select("g", F.lit(0).cast("long").alias("run"), "path")
        if upper is not None:
            tops = tops.unionByName(upper)
        found = runs.join(written(tops, "merkle-tops"), ["g", "run"])
        if tier == 0:
            return found.join(forest.runs.drop("n"), ["g", "run"])
        nodes = F.transform(F.get("levels", F.lit(0)), lambda _, i: F.struct((F.col("run") * (1 << LEVELS) + i).alias("run"), F.concat(_own_path(F.col("levels"), i), F.col("path")).alias("path")))
        upper = found.select("g", F.explode(nodes).alias("x")).select("g", "x.run", "x.path")
    raise AssertionError("a forest has a tier")


def _folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(node: Column, x: Column) -> Column:
        text = F.when(x["sibling"].isNull(), node).when(x["left"], F.concat(x["sibling"], node)).otherwise(F.concat(node, x["sibling"]))
        return F.sha2(text, 256)

    return F.aggregate(path, leaf, up)


def manifest(rows: DataFrame, group: str, order: list[str], leaf: Column, presented: Column) -> DataFrame:
    """Leaves, roots and proofs of all rows: id columns of `order`, `group`, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of each value of `group` (null: the first group) ascend by `order`
    (nulls first), then by leaf; every two consecutive nodes become their
    digest while more than one remain, a last one alone too. The groups'
    subroots, ordered by group, give the root alike. proof_sha256 is the digest
    of the siblings on the way up. folded_root is recomputed from `presented`,
    the leaf as somebody shows it, and those siblings; verified says whether it
    is the root. Equal rows have equal leaves and a place each. An empty table
    gives an empty result. Other columns of rows are not kept.
    """
    if clash := {"g", "pos", "n", "node", "leaf", "shown", "run"} & {group, *order}:
        raise ValueError(f"the group and the order can't be named {sorted(clash)}")
    spent: list[DataFrame] = []
    slim = rows.select(group_key(group).alias("g"), group, *(c for c in order if c != group), leaf.alias("leaf"), presented.alias("shown"))
    forest = build(numbered(slim.withColumn("shown", F.when(F.col("shown") != F.col("leaf"), F.col("shown"))), [*order, "leaf"], spent), "leaf", [group, *order, "shown"])
    subroots = written(forest.roots, "merkle-subroots")
    upper = build(numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("leaf")), ["name"], spent), "leaf", ["name"])
    for table in spent:  # build() has written all that read them
        drop_written(table)
    nothing = F.array().cast(_PATH)
    root = upper.roots.select(F.col("root").alias("whole"))
    named = F.transform(F.col("rows"), lambda x, i: F.struct(x["name"].alias("g"), F.concat(_own_path(F.col("levels"), i), F.col("path")).alias("path")))
    above = written(paths(upper, upper.roots.select("g", nothing.alias("path"))).select(F.explode(named).alias("x")).select("x.*"), "merkle-above")
    found = paths(forest, above)

    def proved(x: Column, i: Column) -> Column:
        way = F.concat(_own_path(F.col("levels"), i), F.col("path"))
        proof = F.sha2(F.array_join(F.transform(way, lambda e: e["sibling"]), ""), 256)  # array_join leaves nulls out
        return F.struct(*(x[c].alias(c) for c in dict.fromkeys([*order, group])), x["node"].alias("leaf"), proof.alias("proof_sha256"), _folded(F.coalesce(x["shown"], x["node"]), way).alias("folded_root"))

    leaves = found.select("g", F.explode(F.transform("rows", proved)).alias("x")).select("g", "x.*")
    whole = root.first()
    return (
        leaves.join(subroots.select("g", F.col("root").alias("subroot")), "g")
        .withColumn("root", F.lit(whole["whole"] if whole else None))
        .select(*dict.fromkeys([*order, group]), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents; rows whose id's crc32 is divisible by 7 present n_chars + 1."""
    leaf = digest(*(field(F.col(c)) for c in FIELDS))
    tampered = digest(*(field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS))
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return manifest(docs, "lang", ["doc_id"], leaf, F.when(marked, tampered).otherwise(leaf)).drop("lang")
