"""Reading the driver's tables and the shared folder."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


#: The most bytes of a batch that goes to a Python worker: batches are bounded by rows otherwise, which long texts make large.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame as it is, in a session that sends batches of few bytes; a smaller bound stays."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file:///tmp/checkpoints/coordspark"
        spark.sparkContext.setCheckpointDir(found)
    return found


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a name in the shared folder, for tasks."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


#: Shuffles of a finished write are of no more use: what is kept is the table.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing but a read."""
    spark = bounded(df).sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
