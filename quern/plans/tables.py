"""Written intermediate tables of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quern.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("quern.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors. codec: of Parquet, the session's if None."""
    path = f"{folder(df.sparkSession)}/quern-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quern_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete a table that written() made and that no lazy plan reads any more."""
    if path := getattr(df, "_quern_path", None):
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """df as a table in the shared folder, dealt by the column `by` as an exchange would deal it: joins on it move the other side only."""
    spark = df.sparkSession
    name = f"quern_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, by).sortBy(by).option("path", f"{folder(spark)}/quern-tables/{name}").saveAsTable(name)
    return spark.table(name)


def drop_bucketed(df: DataFrame, spark: SparkSession) -> None:
    """Forget and delete a table that bucketed() made and that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        name = path.rsplit("/", 2)[1]
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions; a table that has as many stays as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
