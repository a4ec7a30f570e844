"""Streaming ingest, an extension: micro-batches go through the batch ingest, replays replace what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store
from ..plans import pipelines as P


def ingest_stream(sources: DataFrame, store: Store, checkpoint: str, settings: P.Settings | None = None) -> StreamingQuery:
    """Write documents, chunks, postings, vectors and jobs of each micro-batch; documents that come again replace what they had."""
    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        index = P.ingest(df, settings)
        store.replace_documents(index.documents, index.chunks, index.postings, index.vectors, index.jobs.drop("ord"))
        store.vacuum()

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; works on streams and tables."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id", event_id: str = "event_id") -> DataFrame:
    """(by, start, end, n, total): runs of a user's events that are no more than `gap` apart, each event once; end is the last event and the gap.

    Works on streams and tables. A stream takes events in any order that are at
    most `late` behind the newest; an event that comes again within that time
    is dropped by its id, and a session is put out when no event can join it any
    more. Events that come later than that are dropped. Null times are in no
    session; null ids count as one event.
    """
    known = events.where("ts IS NOT NULL")
    once = known.withWatermark("ts", late).dropDuplicatesWithinWatermark([event_id]) if events.isStreaming else known.dropDuplicates([event_id])
    held = once.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return held.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def write_sessions(events: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append the finished sessions of a stream to a Parquet table; a restart goes on where the checkpoint ends."""
    out = sessions(events, **options).writeStream.outputMode("append").format("parquet").option("path", path)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
