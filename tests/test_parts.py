"""The settings' parts equal the direct calls; the invariants of an answer; sessions of a stream."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import vectors as V
from quern.operators import graph, search, tools
from quern.plans import pipelines as P
from quern.streaming import ingest as streaming

TEXTS = {
    "a": "# Guide\n\nThe tool by Borg saves data nightly. Here Borg met Acme today.\n\n## More\n\nIt runs on every host and writes logs.\n",
    "b": "# Notes\n\nSome say Acme makes widgets in Paris. They sell them.\n",
    "c": "# Other\n\nThe guide to gardening and soil, which Paris likes.\n",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(k, "text/markdown", t) for k, t in TEXTS.items()]
    return P.ingest(spark.createDataFrame(rows, "source_id string, media_type string, text string").coalesce(1))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "which tool saves data"), (2, "what does Paris have")], "query_id int, query string")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def test_modes_equal_direct_calls(spark, index, asked):
    for mode, direct in {"max_sim": lambda: search.max_sim(asked, index.chunks, 3), "graph": lambda: graph.retrieve(asked, *graph.build(index.chunks), 3)}.items():
        got = P.retrieve(asked, index, P.Settings(mode=mode, top_k=3))
        assert hits(got) == hits(direct()) and hits(got)
    quantised = P.retrieve(asked, index, P.Settings(mode="dense", quantised=True, rescore=2, top_k=2))
    vectors = V.hashed_vectors(asked, "query_id", "query")
    assert hits(quantised) == hits(search.quantised_search(vectors, index.vectors, 2, 2))
    assert P.answer(asked, index, P.Settings(mode="graph", top_k=2)).where("query_id = 2").first()["citations"]
    for wrong in ({"mode": "none"}, {"top_k": 0}, {"rerank_top_k": -1}):
        with pytest.raises(ValueError):
            P.search_once(asked, index, P.Settings(**wrong))


def test_vectors_of_settings(spark, index, asked):
    chunks = index.chunks.withColumn("indexed", F.col("text"))
    late = {r["chunk_id"]: r["vec"] for r in P.chunk_vectors(chunks, "indexed", P.Settings(late_chunking=True, late_alpha=0.3, truncate=200)).collect()}
    plain = {r["chunk_id"]: r["vec"] for r in P.chunk_vectors(chunks, "indexed", P.Settings(truncate=200)).collect()}
    by_doc = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["document_id"], r["section_ord"], r["chunk_ord"])):
        by_doc.setdefault(r["document_id"], []).append(r["chunk_id"])
    assert sorted(map(len, by_doc.values())) == [1, 1, 2]
    for ids in by_doc.values():
        for i, c in enumerate(ids):
            near = ids[max(0, i - 1) : i + 2]
            mixed = [0.7 * x + 0.3 * sum(plain[n][d] for n in near) / len(near) for d, x in enumerate(plain[c])]
            size = sum(x * x for x in mixed) ** 0.5 or 1.0
            assert late[c] == pytest.approx([x / size for x in mixed])
    said = P.query_vectors(asked, P.Settings(instruction="find", late_chunking=True)).collect()
    want = V.hashed_vectors(asked.withColumn("query", V.instructed(F.col("query"), "find")), "query_id", "query").collect()
    assert {r["query_id"]: r["vec"] for r in said} == {r["query_id"]: r["vec"] for r in want}
    own = P.query_vectors(asked, P.Settings(query_embedder=lambda c: F.array(F.length(c).cast("double")))).collect()
    assert {tuple(r["vec"]) for r in own} == {(21.0,), (20.0,)}


def test_rerank_top_k_models_and_citations(spark, index, asked):
    got = P.answer(asked, index, P.Settings(top_k=3, rerank_top_k=1, reranker="listwise")).collect()
    assert all(len(r["retrieved_ids"]) == 3 and len(r["contexts"]) == len(r["citations"]) == 1 for r in got)
    said = P.answer(asked, index, P.Settings(top_k=4, mode="sparse", generator=lambda q, c: F.lit("so"))).collect()
    assert all(r["answer"] == "so" and len(r["citations"]) == len(r["contexts"]) == 4 and r["citations"][0]["snippet"] == r["contexts"][0][:240] for r in said)

    def model(messages):
        return tools.Turn(text="it is 6", calls=[]) if len(messages) > 1 else tools.Turn(calls=[("1", "calculator", {"expression": "2*3"})])

    used = P.answer(asked, index, P.Settings(top_k=2, tool_model=model)).collect()
    assert all((r["answer"], r["tool_value"], len(r["citations"])) == ("it is 6", 6.0, 2) for r in used)
    retrieved = P.retrieve(asked, index, P.Settings(top_k=1, mode="sparse"))
    more = search.attach(P.retrieve(asked, index, P.Settings(top_k=3, mode="sparse")), index.chunks)
    with pytest.raises(Exception, match="a context was not retrieved"):
        P.generate(more, asked, P.Settings(), retrieved).collect()


def test_engine_reports_stages(spark, tmp_path):
    e = Engine(spark, str(tmp_path), P.Settings(reranker="listwise"), models=("hash-emb-v1", "own-1"))
    empty = e.query("anything")
    assert empty["answer"] == "" and set(empty["timings_ms"]) == {"retrieve", "rerank", "generate", "total"} and empty["estimated_cost_usd"] == 0.0
    e.ingest(spark.createDataFrame([(k, "text/markdown", t) for k, t in TEXTS.items()], "source_id string, media_type string, text string"))
    said = e.query("which tool saves data", top_k=3, mode="sparse", rerank_top_k=1)
    assert "Borg" in said["answer"] and len(said["citations"]) == 1 and len(said["retrieved_ids"]) == 3
    assert said["model_ids"] == {"embedding": "hash-emb-v1", "reranker": "listwise", "generator": "own-1"}
    assert said["timings_ms"]["total"] >= said["timings_ms"]["retrieve"] > 0


EVENTS = "event_id long, user_id long, ts timestamp, value double"


def test_sessions_of_a_stream_with_late_and_repeated_events(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    events = [(i, rng.randint(0, 4), start + dt.timedelta(seconds=rng.randint(0, 86_400)), float(i)) for i in range(300)]
    events.sort(key=lambda e: e[2])
    for i in range(0, 290, 7):  # out of order, by under two hours
        events[i], events[i + 5] = events[i + 5], events[i]
    batches = [events[i : i + 75] for i in range(0, 300, 75)]
    batches[1] += batches[0][-10:]  # some come again
    flush = [(10_000 + u, u, start + dt.timedelta(days=9), 0.0) for u in range(5)]
    too_late = [(20_000, 1, start, 1.0)]
    for n, rows in enumerate([*batches, flush, too_late]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        streaming.write_sessions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()  # each restart goes on
        assert n < 5 or spark.read.parquet(str(tmp_path / "out")).count() > 5
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("user_id", "start", "end", "n", "total").collect()))
    batch = streaming.sessions(spark.createDataFrame(events, EVENTS)).collect()
    assert got == sorted((r["user_id"], r["start"], r["end"], r["n"], r["total"]) for r in batch)


def test_sessions_of_a_table(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, 1, at(0), 1.0), (1, 1, at(0), 1.0), (2, 1, at(30), 2.0), (3, 1, at(0) + dt.timedelta(minutes=60, microseconds=1), 4.0), (4, 2, None, 1.0), (None, 3, at(1), 1.0)]
    got = sorted((r["user_id"], r["start"].hour, r["n"], r["total"]) for r in streaming.sessions(spark.createDataFrame(rows, EVENTS)).collect())
    assert got[0] == (1, 0, 2, 3.0) and got[1] == (1, 1, 1, 4.0) and got[2][0] == 3 and streaming.sessions(spark.createDataFrame([], EVENTS)).count() == 0
