"""One object for interactive use: ingest sources, ask, list and delete documents, look up jobs. Tables live under one path."""

from __future__ import annotations

import time
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import stable_id
from .operators import context as C
from .operators import store as S
from .operators.search import attach
from .plans import pipelines as P
from .plans.tables import drop_written, written

SNAPSHOT = "snapshot_id string, profile string, embedding_model string, dimensions int, created_at timestamp"


class UnknownId(KeyError):
    """No document or job has this id."""


class Engine:
    """Facade over a store of ingested tables."""

    def __init__(self, spark: SparkSession, path: str, settings: P.Settings | None = None, prices: DataFrame | None = None, models: tuple[str, str] = ("hash-emb-v1", "extractive-v1")) -> None:
        """prices: (prefix, usd_in, usd_out) a million tokens, by which model ids are priced; models: ids of the embedder and the generator."""
        self.spark, self.settings, self.store = spark, settings or P.Settings(), S.Store(spark, path)
        self.prices, self.models = prices, models

    def ingest(self, sources: DataFrame) -> list[dict]:
        """Index a batch; documents that were there before are replaced. One job for each source, failed ones included, in the input's order."""
        index = P.ingest(sources, self.settings)
        docs = index.documents.withColumn("chunk_strategy", F.lit(self.settings.chunk_strategy))
        jobs = index.jobs.withColumn("updated_at", F.current_timestamp())
        self.store.replace_documents(docs, index.chunks, index.postings, index.vectors, jobs.drop("ord"))
        self.store.vacuum()
        return [r.asDict() for r in jobs.orderBy("ord").drop("ord").collect()]

    def _index_or_none(self) -> P.Index | None:
        """The tables of one version of the store."""
        version = self.store.version()
        t = [self.store.read(n, version) for n in ("chunks", "postings", "dense", "jobs", "documents")]
        return None if t[0] is None else P.Index(*t)

    def cost(self, query: str, contexts: list[str], answer: str) -> float:
        """Estimated USD of one answer: four characters a token, the query embedded once, query and contexts read, the answer written."""
        if self.prices is None:
            return 0.0
        usage = [(self.models[0], len(query), 0), (self.models[1], len(query) + sum(map(len, contexts)), len(answer))]
        rows = C.cost(self.spark.createDataFrame(usage, "model_id string, input_chars long, output_chars long"), self.prices)
        return float(rows.agg(F.sum("estimated_cost_usd")).first()[0])

    def query(self, text: str, top_k: int = 5, mode: str = "hybrid", fusion: str = "rrf", rerank_top_k: int | None = None) -> dict:
        """Answer, citations, times of the stages and model ids of one question; nothing ingested or found: an empty answer."""
        began = time.perf_counter()
        settings = replace(self.settings, top_k=top_k, mode=mode, fusion=fusion, rerank_top_k=rerank_top_k)
        asked = self.spark.createDataFrame([(0, text)], "query_id int, query string")
        out: dict = {"answer": "", "citations": [], "retrieved_ids": []}
        contexts: list[str] = []
        took = {"retrieve": 0.0, "rerank": 0.0, "generate": 0.0}
        if (index := self._index_or_none()) is not None:
            at = time.perf_counter()

            def stage(name: str, df: DataFrame) -> DataFrame:
                nonlocal at
                held = written(df, f"query-{name}")
                took[name] = (time.perf_counter() - at) * 1000
                at = time.perf_counter()
                return held

            hits = stage("retrieve", P.retrieve(asked, index, settings))
            best = stage("rerank", P.rerank(attach(hits, index.chunks), asked, settings))
            row = stage("generate", P.generate(best, asked, settings, hits)).first()
            contexts = row["contexts"] or []
            if contexts:
                out = {"answer": row["answer"], "citations": [c.asDict(True) for c in row["citations"]], "retrieved_ids": row["retrieved_ids"] or []}
            for held in (hits, best):
                drop_written(held)
        total = (time.perf_counter() - began) * 1000
        ids = {"embedding": self.models[0], "reranker": "model" if settings.order else settings.reranker, "generator": self.models[1]}
        return out | {"timings_ms": took | {"total": total}, "model_ids": ids, "estimated_cost_usd": self.cost(text, contexts, out["answer"]) if contexts else 0.0}

    def documents(self) -> list[dict]:
        docs, chunks = self.store.read("documents"), self.store.read("chunks")
        return [] if docs is None else [r.asDict() for r in S.document_list(docs, chunks).collect()]

    def document(self, document_id: str) -> dict:
        docs = self.store.find("documents", "document_id", document_id)
        row = None if docs is None else S.document_list(docs, self.store.find("chunks", "document_id", document_id)).first()
        if row is None:
            raise UnknownId(document_id)
        return row.asDict()

    def document_id_of(self, source_id: str) -> str | None:
        """Id of the document that a source gave."""
        docs = self.store.find("documents", "source_id", source_id)
        row = None if docs is None else docs.first()
        return row and row["document_id"]

    def delete(self, document_id: str) -> list[str]:
        """Remove a document, its chunks and vectors; ids of the chunks."""
        self.document(document_id)
        return self.store.delete_document(document_id)

    def job(self, job_id: str) -> dict:
        jobs = self.store.read("jobs")
        row = None if jobs is None else jobs.where(F.col("job_id") == job_id).first()
        if row is None:
            raise UnknownId(job_id)
        return row.asDict()

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def snapshot(self, profile: str = "test") -> dict:
        """Save the configuration that decides whether old vectors can be searched; `drifted` if the newest one differs."""
        model = f"hash-v1-{self.settings.dim}" if self.settings.embedder is None else self.models[0]
        row = self.spark.createDataFrame([(profile, model, self.settings.dim)], "profile string, embedding_model string, dimensions int")
        row = row.select(stable_id(F.col("profile"), F.col("embedding_model"), F.col("dimensions")).alias("snapshot_id"), "*", F.current_timestamp().alias("created_at"))
        old = self.store.read("config_snapshots")
        last = None if old is None else S.latest(old).first()
        self.store.upsert("config_snapshots", row, ["snapshot_id"])
        now = row.select("snapshot_id").first()[0]
        return {"snapshot_id": now, "drifted": last is not None and last["snapshot_id"] != now, "settings": asdict(self.settings)}
