from __future__ import annotations

import pytest

from quern.engine import Engine, UnknownId
from quern.plans.pipelines import Settings
from quern.streaming.ingest import ingest_stream


def test_engine_life_cycle(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.health()["status"] == "ok" and e.query("anything")["answer"] == "" and e.documents() == []
    rows = [("a", "text/markdown", "# Guide\n\nThe Borg backup tool saves data.\n"), ("x", "image/png", "")]
    src = spark.createDataFrame(rows, "source_id string, media_type string, text string")
    jobs = {j["source_id"]: j for j in e.ingest(src)}
    assert jobs["a"]["status"] == "succeeded" and jobs["x"]["status"] == "failed" and e.job(jobs["a"]["job_id"])["chunk_count"] == 1
    e.ingest(src)  # once more: nothing is doubled
    assert [(d["source_id"], d["chunk_count"]) for d in e.documents()] == [("a", 1)]
    said = e.query("which backup tool", top_k=1)
    assert "Borg" in said["answer"] and len(said["citations"]) == 1
    doc = e.documents()[0]["document_id"]
    assert e.document(doc)["chunk_count"] == 1 and e.document_id_of("a") == doc and e.document_id_of("none") is None
    assert len(e.delete(doc)) == 1 and e.documents() == []
    for call in (lambda: e.delete(doc), lambda: e.job("none"), lambda: e.document("none")):
        with pytest.raises(UnknownId):
            call()
    assert e.snapshot()["drifted"] is False and Engine(spark, str(tmp_path), Settings(dim=64)).snapshot()["drifted"] is True


def test_jobs_and_stale_chunks(spark, tmp_path):
    schema = "source_id string, media_type string, text string"
    prices = spark.createDataFrame([("big-", 1.0, 4.0)], "prefix string, usd_in double, usd_out double")
    e = Engine(spark, str(tmp_path), prices=prices, models=("hash-emb-v1", "big-1"))
    jobs = e.ingest(spark.createDataFrame([("z", "text/markdown", "# Z\n\nBorg saves data.\n"), ("bad", "image/png", ""), ("a", "text/markdown", "  ")], schema))
    assert [(j["source_id"], j["status"], j["chunk_count"]) for j in jobs] == [("z", "succeeded", 1), ("bad", "failed", 0), ("a", "succeeded", 0)]
    assert [d["chunk_count"] for d in e.documents()] == [0, 1] or [d["chunk_count"] for d in e.documents()] == [1, 0]
    said = e.query("borg", top_k=1)
    read = 4 + len(e.store.read("chunks").first()["text"])
    assert said["estimated_cost_usd"] == pytest.approx((read * 1.0 + len(said["answer"]) * 4.0) / 4e6)
    again = e.ingest(spark.createDataFrame([("z", "text/markdown", ""), ("bad", "text/markdown", "Now it can be read.")], schema))
    assert again[0]["job_id"] == jobs[0]["job_id"] and again[1]["job_id"] == jobs[1]["job_id"] and e.job(jobs[1]["job_id"])["status"] == "succeeded"
    assert [r["text"] for r in e.store.read("chunks").collect()] == ["Now it can be read."] and e.store.read("dense").count() == 1
    e.store.drop("jobs")
    with pytest.raises(KeyError):
        e.store.drop("jobs")


def test_ingest_stream_can_be_searched(spark, tmp_path):
    schema = "source_id string, media_type string, text string"
    folder, e = str(tmp_path / "in"), Engine(spark, str(tmp_path / "store"))
    for text in ("The Borg backup tool saves data.", ""):
        spark.createDataFrame([("a", "text/markdown", text), ("b", "text/markdown", "Zetacorp makes widgets.")], schema).coalesce(1).write.mode("append").json(folder)
        ingest_stream(spark.readStream.schema(schema).json(folder), e.store, str(tmp_path / "cp")).awaitTermination()
        assert ("Borg" in e.query("borg backup", top_k=2)["answer"]) == bool(text)
