"""Shared helpers: written intermediate tables, word splitting, Arrow row streams."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs without space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder is made once and set for the session,
    in local mode (tests); on a cluster executors would not see it: an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quern.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
        atexit.register(_remove_local, folder)
    return folder.rstrip("/")


def _remove_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quern_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete a table that written() made and that no lazy plan reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def split_words(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() cuts at exactly the six ASCII blanks of WORD_PATTERN."""
    return text.encode().split() if text else []


def column_blocks(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows, so that working memory follows the block."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a block's texts hold about `most` bytes; a longer text stands alone."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def without(docs: DataFrame, added: list[str], *needed: str) -> DataFrame:
    """docs without columns that an operator adds under the same name; ValueError if it reads one of them."""
    if clash := {*added} & {*needed}:
        raise ValueError(f"the operator adds {sorted(clash)}, which it can't read too")
    return docs.drop(*added)


def grouped(rows: DataFrame, key: str, columns: list[str], work: Callable[[int, dict[str, list]], Iterator[tuple]], schema: str, names: list[str]) -> DataFrame:
    """Run work on the rows of each key, streamed in key order; work yields result rows as tuples of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in columns}
        current: int | None = None
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate([o[i] for o in out])) for i in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            data = {c: b.column(i + 1).to_pylist() for i, c in enumerate(columns)}
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if current is not None and keys[s] != current:
                    for r in work(current, held):
                        out.append(r)
                        size += len(r[0])
                    held = {c: [] for c in columns}
                current = keys[s]
                for c in columns:
                    held[c] += data[c][s:e]
            if size > 50_000:
                yield flush()
                size = 0
        if current is not None:
            out += work(current, held)
        if out:
            yield flush()

    return rows.select(key, *columns).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a folder, spread over all cores where their files give fewer partitions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def text_crc32(column: str) -> "F.Column":
    """crc32 of the UTF-8 text, of the empty text if null."""
    return F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary"))
