"""Tables of the engine: bucketed copy-on-write Parquet under one manifest, with upsert, delete and look-ups."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
#: Files that no kept manifest names are removed if they are older than this: a change may still be writing younger ones.
VACUUM_AGE_S = 3600


def upsert(existing: DataFrame | None, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows of new replace rows of the same key, null keys being equal; of equal keys in new the last by `order` stays."""
    if order:
        last = Window.partitionBy(*key).orderBy(F.desc(order))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates(key)
    if existing is None:
        return new
    keys = new.select(*(F.col(k).alias(f"__new_{k}") for k in key))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in key))
    return existing.join(keys, same, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_where(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_anti")


def document_list(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and their numbers of chunks, 0 included, in order of id."""
    return documents.join(chunks.groupBy("document_id").agg(F.count("chunk_id").alias("chunk_count")), "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy("document_id")


def pick(table: DataFrame, ids: list[str], key: str = "chunk_id") -> DataFrame:
    """Rows of the ids, in their order; unknown ids are left out."""
    asked = table.sparkSession.createDataFrame(list(enumerate(ids)), f"__at int, `{key}` string")
    return table.join(F.broadcast(asked), key).orderBy("__at").drop("__at")


def latest(table: DataFrame, by: str = "created_at", ties: str | None = None) -> DataFrame:
    """The newest row."""
    return table.orderBy(F.desc(by), *([F.desc(ties)] if ties else [])).limit(1)


def keep_last(table: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    last = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return table.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


class Conflict(RuntimeError):
    """Another change of the same table was committed first."""


@dataclass
class Table:
    """What a manifest says of one table: its key, the columns that choose a bucket, and the folder that holds each bucket."""

    key: list[str]
    by: list[str]
    buckets: int
    columns: str  # the schema as JSON
    folders: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.columns))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")


class Files:
    """The few file operations that a manifest needs, by Hadoop's clients: any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self._gateway, self._fs = spark.sparkContext._gateway, jvm.org.apache.hadoop.fs
        self._io = jvm.org.apache.commons.io.IOUtils
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self.path(root).getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self._files.getUri(), conf)

    def path(self, name: str):  # noqa: ANN201
        return self._fs.Path(name)

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of what a folder holds; none if it isn't there."""
        at = self.path(folder)
        return [(f.getPath().getName(), f.getModificationTime()) for f in self._files.listStatus(at)] if self._files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._files.open(self.path(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file beside and rename it, which shows all of it or nothing; False if the name is taken."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._files.create(self.path(beside))
        out.write(bytearray(text.encode()))
        out.close()
        how = self._gateway.new_array(self._fs.Options.Rename, 1)
        how[0] = self._fs.Options.Rename.NONE
        try:
            self._context.rename(self.path(beside), self.path(name), how)
        except Py4JJavaError as e:
            self.remove(beside)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self._files.delete(self.path(name), True)


class Change:
    """Tables as one change sees them: it writes new buckets, and nothing is seen of them before the store commits it."""

    def __init__(self, store: Store, number: int, tables: dict[str, Table]) -> None:
        self.store, self.number, self.base = store, number, tables
        self.tables = dict(tables)
        self._staged: list[str] = []

    def read(self, name: str) -> DataFrame | None:
        return self.store._frame(self.tables.get(name), self.tables[name].folders) if name in self.tables else None

    def _held(self, df: DataFrame) -> DataFrame:
        """df as files: what is read twice must not change between."""
        path = f"{self.store.path}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._staged.append(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def _rewrite(self, name: str, table: Table, rows: DataFrame, touched: list[int]) -> None:
        """Put rows in place of the touched buckets; the others keep their folders."""
        folder = f"{name}/{uuid.uuid4().hex}"
        out = f"{self.store.path}/data/{folder}"
        rows.withColumn("__bucket", table.bucket()).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(out)
        there = [n.split("=")[1] for n, _ in self.store.files.listed(out) if n.startswith("__bucket=")]
        kept = {b: f for b, f in table.folders.items() if int(b) not in set(touched)}
        self.tables[name] = Table(table.key, table.by, table.buckets, table.columns, kept | {b: f"{folder}/__bucket={b}" for b in there})

    def write(self, name: str, df: DataFrame, key: list[str] | None = None, by: list[str] | None = None) -> None:
        """The whole table anew."""
        old = self.tables.get(name)
        key = key or (old.key if old else df.columns)
        table = Table(key, by or (old.by if old else key), old.buckets if old else self.store.buckets, df.schema.json())
        self._rewrite(name, table, df, list(range(table.buckets)))

    def upsert(self, name: str, new: DataFrame, key: list[str], order: str | None = None, by: list[str] | None = None) -> None:
        """upsert() of the buckets that new rows fall into. by: the columns of a bucket, which equal keys must share (default: key)."""
        if name not in self.tables:
            return self.write(name, upsert(None, new, key, order), key, by)
        table = self.tables[name]
        staged = self._held(new)
        own = {f.name for f in table.schema}
        added = [f for f in staged.schema if f.name not in own]
        table = Table(table.key, table.by, table.buckets, StructType([*table.schema, *added]).json(), table.folders)
        touched = [r[0] for r in staged.select(table.bucket()).distinct().collect()]  # numbers of buckets
        if touched or added:
            old = self.store._frame(table, {str(b): table.folders[str(b)] for b in touched if str(b) in table.folders})
            self._rewrite(name, table, upsert(old, staged, key, order).select(table.schema.names), touched)
        return None

    def delete(self, name: str, keys: DataFrame, on: list[str]) -> None:
        """Rows that equal one of keys in the columns `on` go; only buckets that hold such rows are written."""
        if (table := self.tables.get(name)) is None:
            return
        gone = self._held(keys.select(*on).distinct())
        source = gone if set(table.by) <= set(on) else self.read(name).join(gone, on, "left_semi")
        touched = [b for (b,) in source.select(table.bucket()).distinct().collect() if str(b) in table.folders]
        if touched:
            old = self.store._frame(table, {str(b): table.folders[str(b)] for b in touched})
            self._rewrite(name, table, delete_where(old, gone, on), touched)

    def drop(self, name: str) -> None:
        """Take a table out of the manifest; KeyError if there is none of this name."""
        del self.tables[name]


class Store:
    """Named tables under one path.

    data/ holds folders of buckets, each written once; manifests/ holds one file
    for each version, which names the folder of each bucket of each table. A
    change writes the buckets it touches and then the next manifest, by one
    rename that fails if that number is taken: readers see all of a change, over
    all its tables, or nothing, and whatever was committed before stays readable
    until vacuum(). If another change came first, a change is put on top of it
    where they touch different tables, else it raises Conflict (the short forms
    here try again).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.files = Files(spark, self.path)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def version(self) -> int:
        """Number of the newest manifest; 0 if there is none."""
        return max((int(n[:12]) for n, _ in self.files.listed(f"{self.path}/manifests") if n.endswith(".json")), default=0)

    def tables(self, version: int | None = None) -> dict[str, Table]:
        number = self.version() if version is None else version
        return {n: Table(**t) for n, t in json.loads(self.files.read(self._manifest(number))).items()} if number else {}

    def _frame(self, table: Table, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*(f"{self.path}/data/{f}" for f in folders.values()))

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version that vacuum() has left, the newest by default; None without the table."""
        table = self.tables(version).get(name)
        return None if table is None else self._frame(table, table.folders)

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Changes of any tables that are committed together at the end; nothing is if an error comes first."""
        number = self.version()
        work = Change(self, number, self.tables(number) if number else {})
        try:
            yield work
            self._commit(work)
        finally:
            for path in work._staged:
                self.files.remove(path)

    def _commit(self, work: Change) -> None:
        own = {n for n in {*work.base, *work.tables} if work.base.get(n) != work.tables.get(n)}
        number, tables = work.number, work.tables
        while own:
            text = json.dumps({n: asdict(t) for n, t in sorted(tables.items())})
            if self.files.publish(self._manifest(number + 1), text):
                return
            number = self.version()
            now = self.tables(number)
            if clash := [n for n in sorted(own) if now.get(n) != work.base.get(n)]:
                raise Conflict(f"{clash} changed meanwhile")
            tables = {n: t for n, t in now.items() if n not in own} | {n: work.tables[n] for n in own if n in work.tables}

    def _again(self, work: Callable[[Change], None], tries: int = 5) -> None:
        for left in reversed(range(tries)):
            try:
                with self.change() as c:
                    work(c)
                return
            except Conflict:
                if not left:
                    raise

    def write(self, name: str, df: DataFrame, key: list[str] | None = None) -> DataFrame:
        self._again(lambda c: c.write(name, df, key))
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
        self._again(lambda c: c.upsert(name, new, key, order))
        return self.read(name)

    def delete(self, name: str, keys: DataFrame, on: list[str]) -> None:
        self._again(lambda c: c.delete(name, keys, on))

    def vacuum(self, keep: int = 2, age_s: float = VACUUM_AGE_S) -> int:
        """Delete all but the newest `keep` versions and the buckets that only the deleted ones name; number of folders deleted.

        Files younger than age_s stay, since a change that isn't committed yet
        may have written them, and so do versions younger than that.
        """
        limit = (time.time() - age_s) * 1000
        listed = sorted(self.files.listed(f"{self.path}/manifests"))
        old = [n for n, at in [x for x in listed if x[0].endswith(".json")][:-keep] if at <= limit]
        for name in [*old, *(n for n, at in listed if n.endswith(".tmp") and at <= limit)]:
            self.files.remove(f"{self.path}/manifests/{name}")
        kept = [int(n[:12]) for n, _ in listed if n.endswith(".json") and n not in old]
        used = {f for v in kept for t in self.tables(v).values() for f in t.folders.values()}
        gone = 0
        for name, _ in self.files.listed(f"{self.path}/data"):
            for folder, at in self.files.listed(f"{self.path}/data/{name}"):
                if at > limit:
                    continue
                parts = [n for n, _ in self.files.listed(f"{self.path}/data/{name}/{folder}") if n.startswith("__bucket=")]
                idle = [p for p in parts if f"{name}/{folder}/{p}" not in used]
                for p in idle if len(idle) < len(parts) else [""]:
                    self.files.remove(f"{self.path}/data/{name}/{folder}/{p}".rstrip("/"))
                gone += len(idle)
        for name, at in self.files.listed(f"{self.path}/staged"):
            if at <= limit:
                self.files.remove(f"{self.path}/staged/{name}")
        return gone

    def replace_documents(self, documents: DataFrame, chunks: DataFrame, postings: DataFrame, dense: DataFrame, jobs: DataFrame) -> None:
        """Put an ingested batch in place of what its documents had, in one change; a document that has no chunk now loses those it had."""

        def work(c: Change) -> None:
            again = documents.select("document_id").distinct()
            if (old := c.read("chunks")) is not None:
                gone = c._held(old.join(again, "document_id", "left_semi").select("chunk_id"))
                for name in ("postings", "dense"):
                    c.delete(name, gone, ["chunk_id"])
                c.delete("chunks", again, ["document_id"])
            c.upsert("documents", documents, ["document_id"])
            c.upsert("chunks", chunks, ["chunk_id"], by=["document_id"])
            c.upsert("postings", postings, ["chunk_id", "idx"], by=["chunk_id"])
            c.upsert("dense", dense, ["chunk_id"])
            c.upsert("jobs", jobs, ["job_id"])

        self._again(work)

    def find(self, name: str, column: str, value: str) -> DataFrame | None:
        """Rows of one table with this value, of one bucket if the column chooses it; None without the table."""
        if (table := self.tables().get(name)) is None:
            return None
        folders = table.folders
        if table.by == [column]:
            b = self.spark.range(1).select(F.lit(value).cast(table.schema[column].dataType).alias(column)).select(table.bucket()).first()[0]
            folders = {k: f for k, f in folders.items() if int(k) == b}
        return self._frame(table, folders).where(F.col(column) == value)

    def drop(self, name: str) -> None:
        """Take a table away; KeyError if there is none of this name. vacuum() deletes its files."""
        self._again(lambda c: c.drop(name))

    def delete_document(self, document_id: str) -> list[str]:
        """Remove a document from all tables, in one change; ids of its chunks, sorted (unknown document: none)."""
        chunks = self.find("chunks", "document_id", document_id)
        gone = [] if chunks is None else [r[0] for r in chunks.select("chunk_id").orderBy("chunk_id").collect()]  # of one document
        key = self.spark.createDataFrame([(document_id,)], "document_id string")
        ids = self.spark.createDataFrame([(g,) for g in gone], "chunk_id string")

        def work(c: Change) -> None:
            for name in ("postings", "dense"):
                c.delete(name, ids, ["chunk_id"])
            for name in ("chunks", "documents"):
                c.delete(name, key, ["document_id"])

        self._again(work)
        return gone
