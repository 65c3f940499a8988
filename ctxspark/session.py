"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a temporary one; on a cluster, where each machine would have its own,
    that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ctxspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` as the JVM knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage like ``checkpoint()`` and survives lost executors, but the copy is columnar and
    compressed, and later scans prune its columns. The application owns the table: it goes when the application ends.
    ``replaces``: an earlier table that nothing reads any more once this one is written, as in a loop; it goes now.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _hadoop_path(spark, path)
    files.deleteOnExit(at)
    if old := getattr(replaces, "own_table", None):
        files.delete(_hadoop_path(spark, old)[1], True)
    out = spark.read.schema(df.schema).parquet(path)
    out.own_table = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint()`` in the shared folder, for the small state of iterative jobs."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
