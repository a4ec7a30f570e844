from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import graph
from quern.plans import tables


def walk(adj, seeds, alpha, rounds):
    """Power iteration over all nodes; nodes without an edge give their rank to every node."""
    start = {s: 1 / len(seeds) for s in seeds}
    rank = dict(start)
    for _ in range(rounds):
        new = dict.fromkeys(adj, 0.0)
        for v, r in rank.items():
            out = adj[v] or dict.fromkeys(adj, 1.0)
            total = sum(out.values())
            for u, w in out.items():
                new[u] += (1 - alpha) * r * w / total
        for s, p in start.items():
            new[s] += alpha * p
        rank = new
    return rank


def example(spark):
    rng = random.Random(2)
    names = [f"Ent{chr(97 + i)}" for i in range(14)]
    rows = [(f"c{i:02}", "now " + " and ".join(rng.sample(names[:9], rng.randint(1, 4)))) for i in range(15)] + [(f"z{i}", f"lone {n} here") for i, n in enumerate(names[9:])] + [("none", "nothing"), ("again", "lone Entj here")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    found = {c: graph.entities_of(t) for c, t in rows}
    adj = defaultdict(lambda: defaultdict(float))
    for es in found.values():
        for a in es:
            adj[a]  # noqa: B018
            for b in es:
                if a != b:
                    adj[a][b] += 1
    return chunks, found, adj


QUERIES = [("linked", "ask Enta or Entb"), ("mixed", "ask Entc or Entk"), ("lone", "ask Entj or Entl"), ("unknown", "ask Nobody"), ("blank", "")]


@pytest.mark.parametrize("rounds", [1, 2, 7, 50])
def test_ranks_equal_power_iteration(spark, rounds):
    chunks, found, adj = example(spark)
    mentions, edges = graph.build(chunks)
    q = spark.createDataFrame(QUERIES, "query_id string, query string")
    got = defaultdict(list)
    for r in graph.retrieve(q, mentions, edges, 6, iterations=rounds).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_id"], r["score"]))
    for name, text in QUERIES:
        seeds = [e for e in graph.entities_of(text) if e in adj]
        rank = walk(adj, seeds, 0.5, rounds) if seeds else {}
        scores = {c: sum(rank.get(e, 0) for e in es) for c, es in found.items()}
        want = sorted(((c, s) for c, s in scores.items() if s > 0), key=lambda x: (-round(x[1], 9), x[0]))[:6]
        assert [c for c, _ in got[name]] == [c for c, _ in want] and [s for _, s in got[name]] == pytest.approx([s for _, s in want], abs=1e-11)


def test_edges_stay_where_they_are(spark):
    chunks, _, _ = example(spark)
    _, edges = graph.build(chunks)
    step = tables.bucketed(edges, "probe", "src")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranks = spark.range(5).select(F.col("id").cast("string").alias("src"), F.rand().alias("r")).repartition(2)
        plan = ranks.join(step, "src")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    tables.drop_bucketed(step, spark)
    assert not [t for t in spark.catalog.listTables() if "probe" in t.name]


def test_page_rank_bounds(spark):
    chunks, _, adj = example(spark)
    mentions, edges = graph.build(chunks)
    nodes = mentions.select(F.col("entity").alias("node")).distinct()
    seeds = spark.createDataFrame([("q", "enta")], "query_id string, node string")
    for wrong in ({"iterations": 0}, {"alpha": 0.0}):
        with pytest.raises(ValueError):
            graph.page_rank(edges, nodes, seeds, **wrong)
    got = graph.page_rank(edges, nodes, seeds, iterations=500)  # stops long before
    rank = {r["node"]: r["rank"] for r in got.rank.collect()}
    assert got.whole is None and rank == pytest.approx({k: v for k, v in walk(adj, ["enta"], 0.5, 60).items() if v > 0}, abs=1e-10)
    assert graph.page_rank(edges.where("false"), nodes.where("false"), seeds).rank.count() == 0
