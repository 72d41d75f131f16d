"""Ordered computations that stay parallel when one key holds much of the data.

A plain ``Window.partitionBy(cell)`` sends a whole cell to one task. Here the rows of a key are cut
into blocks along the order; windows run inside a block, a small table with one row per
(key, block) carries totals across blocks, and look-back or look-ahead over a few rows is served by
copying the edge rows of a block to its neighbour.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltarc.sources.stages import shared_folder

BLOCK_ROWS = 4096
BLOCK = "_blk"


def range_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cut ``df`` into contiguous ranges of ``order``; the block number of a row is frozen.

    Range bounds follow the data, so a hot key is spread over several blocks. The result is
    written to the shared folder because a second evaluation could pick other bounds.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/voltarc-ranges-{uuid.uuid4().hex}"
    (df.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id().cast("long"))
       .write.parquet(path))
    return spark.read.parquet(path)


def number_blocks(df: DataFrame, order: str, rows: int | None = None) -> DataFrame:
    """Blocks of ``rows`` consecutive values of an integer order column."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(rows or BLOCK_ROWS)))


def _same(keys: Sequence[str]) -> list[str]:
    return [*keys, BLOCK]


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                  total: str | None = None) -> DataFrame:
    """Dense 0-based row position per key; ``total`` also adds the number of rows of the key."""
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*_same(keys)).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*_same(keys)).orderBy(*order)
    return (df.join(offsets.drop("_n"), _same(keys))
              .withColumn(name, F.row_number().over(inside) - F.lit(1) + F.col("_off"))
              .drop("_off"))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 sums: Mapping[str, Column]) -> DataFrame:
    """Running totals (current row included) per key along ``order``; needs blocks."""
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*_same(keys)).agg(
        *[F.sum(F.coalesce(expr, F.lit(0))).alias(f"_t_{name}") for name, expr in sums.items()])
    carried = totals.select(*_same(keys), *[
        F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_c_{name}")
        for name in sums])
    inside = (Window.partitionBy(*_same(keys)).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = df.join(carried, _same(keys))
    for name, expr in sums.items():
        out = out.withColumn(
            name, F.sum(F.coalesce(expr, F.lit(0))).over(inside) + F.col(f"_c_{name}"))
    return out.drop(*[f"_c_{name}" for name in sums])


def nearest_known(df: DataFrame, keys: Sequence[str], position: str, value: str,
                  before: str, after: str) -> DataFrame:
    """Adds the last known and the next known ``struct(pos, val)`` of ``value`` (row included)."""
    known = F.when(F.col(value).isNotNull(),
                   F.struct(F.col(position).alias("pos"), F.col(value).alias("val")))
    # looking ahead runs on the reversed order: a frame that ends at the partition's end is
    # evaluated anew for every row, one that starts at its beginning grows with the rows
    def latest(name, keys, order, until):
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, until)
        return F.last(name, ignorenulls=True).over(frame)

    edges = df.groupBy(*_same(keys)).agg(F.max(known).alias("_hi"), F.min(known).alias("_lo"))
    carried = edges.select(
        *_same(keys), latest("_hi", keys, F.asc(BLOCK), -1).alias("_prev"),
        latest("_lo", keys, F.desc(BLOCK), -1).alias("_next"))
    return (df.join(carried, _same(keys)).withColumn("_known", known)
              .withColumn(before, F.coalesce(
                  latest("_known", _same(keys), F.asc(position), 0), "_prev"))
              .withColumn(after, F.coalesce(
                  latest("_known", _same(keys), F.desc(position), 0), "_next"))
              .drop("_prev", "_next", "_known"))


class Halo:
    """Blocks of a dense position with copies of the edge rows of the neighbouring blocks.

    ``before`` / ``after`` say how many rows a window may look back / ahead. Use :attr:`window`
    for the expressions on :attr:`rows`, then :meth:`own` to drop the copies.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], position: str, before: int = 0,
                 after: int = 0, rows: int | None = None):
        rows = max(rows or BLOCK_ROWS, before + 1, after + 1)
        home = F.floor(F.col(position) / F.lit(rows))
        inside = F.pmod(F.col(position), F.lit(rows))
        targets = F.array(
            home,
            F.when(inside >= rows - before, home + 1) if before else F.lit(None).cast("long"),
            F.when(inside < after, home - 1) if after else F.lit(None).cast("long"))
        copies = F.filter(targets, lambda b: b.isNotNull())
        self.rows = (df.drop(BLOCK).withColumn("_home", home)
                       .withColumn(BLOCK, F.explode(copies)))
        self.window = Window.partitionBy(*keys, BLOCK).orderBy(position)

    def own(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(BLOCK) == F.col("_home")).drop(BLOCK, "_home")
