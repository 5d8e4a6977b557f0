"""Session helpers: the settings every job relies on, and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "tallyloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans here are built of many columns; their call sites aren't needed.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only where that is unset and
    the session is local, as in tests, a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if found is None and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: the
    lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in even parts, several a part of its files and at least one a core. Files are cut by
    bytes, but one task reads a whole row group: all rows may come from one of many parts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, 4 * df.rdd.getNumPartitions()))


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nothing needs any more."""
    _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are deleted at the end; what is needed
    longer must have been written elsewhere by then."""
    token = _made.set([])
    try:
        yield
    finally:
        _delete(spark, _made.get() or [])
        _made.reset(token)


def _delete(spark: SparkSession, folders) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
