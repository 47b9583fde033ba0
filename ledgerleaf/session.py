"""Session helpers: shared scratch space and input spreading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in tests, gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerleaf-")
    context.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of few, small files one partition per core before costly row-wise work.

    Only for plain scans (no shuffle below). A scan of many splits is returned as it is, so large
    tables are never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder: reused without its lineage, also after a
    lost executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder as parquet and read back: for large frames that are read
    several times by different columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_buckets(df: DataFrame, place: str, keys: Sequence[str], buckets: int, by: Iterable[str] = (), name: str | None = None) -> None:
    """Write rows as files by bucket of ``keys`` (and by the columns ``by``): as the table ``name``, or for a table that is
    pointed to them later."""
    spark = df.sparkSession
    # Files are named after their buckets by writing them as a table, which is forgotten again if it was given no name.
    table = name or f"staging_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", place).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.partitionBy(*by) if by else writer).saveAsTable(table)
    if name is None:
        spark.sql(f"DROP TABLE {table}")


def stored_buckets(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """As ``stored``, as a table in buckets of ``keys``: joins and groups by these keys do not move its rows. Each row is
    moved once before, unless the frame is partitioned by the keys already."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    write_buckets(df.repartition(buckets, *keys), scratch_path(spark, name), keys, buckets, name=table)
    return spark.table(table)
