"""Arrays of differing lengths, stored as one stream of values with offsets.

A folder holds two tables. ``values`` is the stream of a block, cut into pages of equal length
whatever the arrays' borders; ``index`` has one row per array: its keys, block, place in the block,
start in the stream and length. Readers that want some arrays, or a range of one, read the pages
that hold them. An array that is longer than a page lies on several, so no task has to hold a row
per value, and pages of short arrays hold many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltarc.sources.stages import discard, settled

PAGE = 4096  # values
PLACE = ["block", "nth"]


def _pages(start: Column, length: Column, page: Column) -> Column:
    return F.sequence(F.floor(start / page), F.floor((start + length - 1) / page))


def _joined(parts: Column) -> Column:
    """The arrays of (position, array) rows of a group, put together in order."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["part"]))


def write_ragged(df: DataFrame, keys: Sequence[str], column: str, path: str, page: int = PAGE
                 ) -> None:
    """Store ``keys`` and the array ``column``. NULL and empty arrays are kept apart, keys may
    repeat or be NULL, an empty table gives an empty store.

    Blocks are the partitions of ``df``, frozen by one write, so no key makes a block large; the
    offsets are running sums over lengths alone, and the arrays move once, to their pages.
    """
    spark = df.sparkSession
    frozen = settled(df.select(
        *keys, F.col(f"`{column}`").alias("_v"), F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")))
    before = Window.partitionBy("block").orderBy("nth").rowsBetween(
        Window.unboundedPreceding, -1)
    length = F.when(F.col("_v").isNotNull(), F.size("_v").cast("long"))
    (frozen.select(*keys, *PLACE, length.alias("length"), F.lit(page).alias("page_size"),
                   F.lit(column).alias("name"))
     .withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
     .write.parquet(f"{path}/index"))
    placed = spark.read.parquet(f"{path}/index").where("length > 0").select(
        *PLACE, "start", "length")
    start, end = F.col("start"), F.col("start") + F.col("length")

    def part(p: Column) -> Column:
        first = F.greatest(start, p * page)
        return F.struct(p.alias("page"), first.alias("at"), F.slice(
            F.col("_v"), (first - start + 1).cast("int"),
            (F.least(end, (p + 1) * page) - first).cast("int")).alias("part"))

    parts = frozen.select(*PLACE, "_v").join(placed, PLACE).select("block", F.explode(F.transform(
        _pages(start, F.col("length"), F.lit(page)), part)).alias("p"))
    (parts.groupBy("block", F.col("p.page").alias("page"))
     .agg(_joined(F.struct("p.at", "p.part")).alias("values"))
     .write.parquet(f"{path}/values"))
    discard(frozen)


def read_ragged(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The stored rows; ``wanted``, a table of keys, reads only the arrays it names."""
    index = spark.read.parquet(f"{path}/index")
    values = spark.read.parquet(f"{path}/values")
    name = index.select("name").first()
    if wanted is not None:
        index = index.join(wanted, wanted.columns, "left_semi")
    keys = [c for c in index.columns if c not in (*PLACE, "length", "page_size", "name", "start")]
    size, start = F.col("page_size"), F.col("start")
    parts = (index.where("length > 0").select(
        *PLACE, "start", "length", "page_size",
        F.explode(_pages(start, F.col("length"), size)).alias("page"))
        .join(values, ["block", "page"]))
    first = F.greatest(start - F.col("page") * size, F.lit(0))
    after = F.least(start + F.col("length") - F.col("page") * size, size)
    whole = parts.select(*PLACE, F.struct("page", F.slice(
        F.col("values"), (first + 1).cast("int"), (after - first).cast("int")).alias("part"))
        .alias("p")).groupBy(*PLACE).agg(_joined(F.col("p")).alias("_v"))
    empty = F.array().cast(values.schema["values"].dataType)
    return index.join(whole, PLACE, "left").select(
        *keys, F.when(F.col("length") == 0, empty).otherwise(F.col("_v"))
        .alias(name[0] if name else "values"))
