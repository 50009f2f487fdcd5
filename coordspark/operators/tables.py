"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a small frame that is sent to all tasks.
SMALL = 50_000
#: Fixed value: bytes of a method beyond which the JVM runs it without compiling it.
COMPILED = 8000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or "file:///tmp/checkpoints/coordspark").rstrip("/")


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, stages whose generated method is too large to be compiled are generated in smaller ones."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), COMPILED)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table: what it took to make it ends there, for the plan and for lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with compiled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fitted(df: DataFrame) -> DataFrame:
    """The frame, to be sent to all tasks if it has few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
