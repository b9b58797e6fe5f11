"""Small helpers shared by all operators: checkpoints, sizes, safe names."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for tables between steps; it is deleted when the application ends.

    It lies in the cluster's ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) in a temporary folder.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = os.path.join(tempfile.gettempdir(), f"palimpsest-checkpoints-{os.getuid()}")
    folder = f"{root.rstrip('/')}/palimpsest-{sc.applicationId}"
    if folder not in _folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders.add(folder)
    return folder


_folders: set[str] = set()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with other values for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint(df: DataFrame, **values: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder; ``values``: settings of Spark SQL for this step.

    A written table has a true size, whereas a checkpoint keeps the estimate of
    the plan before it, from which the planner would broadcast what has grown.
    The step's shuffle files go as soon as it is written; otherwise those of
    all steps stay until the driver happens to collect its garbage.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | {k.replace("__", "."): v for k, v in values.items()}):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a checkpoint that nothing reads any more."""
    path = getattr(df, "_written", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ns(col: str | Column = "namespace") -> Column:
    """A namespace, null meaning ``default``."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("default"))


def norm_key(col: str | Column) -> Column:
    """A key compared without case and outer blanks; blank becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(k != "", k)


def partitions_for(rows: int, per_partition: int = 50_000, least: int = 8) -> int:
    """Number of partitions so that each holds a bounded number of rows."""
    return max(least, -(-rows // per_partition))


def unbroadcast(df: DataFrame) -> DataFrame:
    """A frame with a row for each record: joined by sorting, never sent whole through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str, per_partition: int = 20_000) -> DataFrame:
    """A frame whose rows are about to be multiplied, in partitions by rows, which adaptive execution does not merge by bytes."""
    n = partitions_for(df.count(), per_partition, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
