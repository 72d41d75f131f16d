"""Stage tables: Parquet in the shared folder of the cluster, bucketed by (cell, cycle)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a session in one local
    process gets a temporary folder; a cluster, whose machines would not share it, raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="voltarc-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """A small intermediate table, written to the shared folder and scanned back.

    The scan knows its size in bytes, so Spark's own threshold decides before anything runs
    whether a join broadcasts it; a size known only at run time would come after the large side
    had been shuffled.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/voltarc-small-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.settled_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`settled` has returned, once nothing reads them any more."""
    for df in tables:
        if getattr(df, "settled_at", None):
            remove(df.sparkSession, df.settled_at)


class StageStore:
    """Writes stage tables under one fresh folder and hands back their scans.

    A bucketed stage pays one shuffle when it is written; every later window or aggregate whose
    keys start with the bucket columns, and every join of two stages on them, reads the buckets
    without another shuffle.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tag = uuid.uuid4().hex[:12]
        self.folder = f"{shared_folder(spark).rstrip('/')}/voltarc-{self.tag}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def bucketed(self, name: str, df: DataFrame, keys: Sequence[str],
                 order: Sequence[str]) -> DataFrame:
        table = f"voltarc_{self.tag}_{name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (df.repartition(buckets, *keys).write.format("parquet")
           .bucketBy(buckets, *keys).sortBy(*order)
           .option("path", self.path(name)).saveAsTable(table))
        return self.spark.table(table)

    def plain(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("cell_id",),
                fmt: str = "parquet", mode: str = "error") -> None:
    """Per-cell sink: one folder per cell; the parent folder is the combined table."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.partitionBy(*[c for c in partition_by if c in df.columns]).save(path)


def read_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of tables by column name; columns absent from one side become NULL."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
