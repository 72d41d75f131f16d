"""Exact order statistics of many overlapping unions of cells.

A fold's training part is a union of cells, so its counts are sums of the cells' counts. Samples are
counted once per (cell, group, value). A rank search then narrows each union's wanted rank: values of
a group are cut into blocks at sketched quantiles, only the cells' counts per block are added up per
union, and the block that holds the rank is searched on in the same way until its few distinct
values can be added up one by one. Samples are never joined to the unions; what is, is at most
``BLOCKS`` counts per cell and group and round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltarc.sources.stages import discard, settled

BLOCKS = 64
FEW = 256  # distinct values of a block that are added up one by one


def _placed(values: DataFrame, group: list[str], blocks: int) -> DataFrame:
    """Values with the number of their block inside (group, path)."""
    probs = F.array(*[F.lit(k / blocks) for k in range(1, blocks)])
    bounds = values.groupBy(*group, "path").agg(
        F.percentile_approx("x", probs, 100 * blocks).alias("bounds"))
    return values.join(bounds, [*group, "path"]).withColumn(
        "block", F.size(F.filter("bounds", lambda b: b < F.col("x")))).drop("bounds")


def subset_quantiles(samples: DataFrame, group: Sequence[str], cell: str, value: str,
                     members: DataFrame, union: str, prob: float = 0.5, blocks: int = BLOCKS,
                     few: int = FEW) -> DataFrame:
    """``union``, group columns and ``quantile``: the interpolated quantile of ``value`` over the cells
    that ``members`` (union, cell; each pair once) lists. NULL and NaN values do not count; a union
    without values of a group has no row."""
    group = list(group)
    counted = settled(samples.select(*group, cell, F.col(value).cast("double").alias("x"))
                      .where("x is not null and not isnan(x)")
                      .groupBy(*group, cell, "x").agg(F.count("*").alias("n")))
    members = members.select(union, cell)
    key = [union, *group]
    # per union and group: the two ranks between which the quantile lies
    size = counted.groupBy(*group, cell).agg(F.sum("n").alias("n"))
    total = (size.join(members, cell).groupBy(*key).agg(F.sum("n").alias("total")))
    at = F.lit(prob) * (F.col("total") - 1)
    wanted = settled(total.select(*key, at.alias("at"), F.explode(F.array(
        F.struct(F.lit(0).alias("upper"), F.floor(at).alias("rank")),
        F.struct(F.lit(1).alias("upper"), F.ceil(at).alias("rank")))).alias("t")).select(
        *key, "at", "t.*", F.lit("").alias("path")))
    values, found, old = counted.withColumn("path", F.lit("")), None, [counted, wanted]
    while True:
        # blocks with few distinct values are read value by value, larger ones are cut again
        sizes = settled(values.groupBy(*group, "path").agg(F.countDistinct("x").alias("distinct")))
        near = sizes.where(F.col("distinct") <= few).drop("distinct")
        done = _picked(values.join(near, [*group, "path"], "left_semi"),
                       wanted.join(near, [*group, "path"], "left_semi"), key, group, cell, members,
                       "x").select(*key, "at", "upper", "x")
        found = done if found is None else found.union(done)
        if sizes.where(F.col("distinct") > few).isEmpty():
            break
        far = sizes.where(F.col("distinct") > few).drop("distinct")
        cut = settled(_placed(values.join(far, [*group, "path"], "left_semi"), group, blocks))
        per_block = cut.groupBy(*group, "path", cell, "block").agg(F.sum("n").alias("n"))
        picked = _picked(per_block, wanted.join(far, [*group, "path"], "left_semi"), key, group,
                         cell, members, "block")
        wanted = settled(picked.select(*key, "at", "upper", "rank", F.concat_ws(
            "/", "path", F.col("block").cast("string")).alias("path")))
        values = settled(cut.withColumn("path", F.concat_ws("/", "path", F.col("block").cast(
            "string"))).drop("block").join(wanted.select(*group, "path").distinct(),
                                           [*group, "path"], "left_semi"))
        discard(cut)
        old += [sizes, wanted, values]
    low, high = (F.max(F.when(F.col("upper") == k, F.col("x"))) for k in (0, 1))
    part = F.first("at") - F.floor(F.first("at"))
    out = settled(found.groupBy(*key).agg((low + (high - low) * part).alias("quantile")))
    discard(*old, sizes)
    return out


def _picked(counts: DataFrame, wanted: DataFrame, key: list[str], group: list[str], cell: str,
            members: DataFrame, what: str) -> DataFrame:
    """The value (or block) ``what`` of each wanted rank, and the rank inside it. ``counts``: group,
    path, cell, ``what``, n, a bounded number of them per (cell, group, path)."""
    sums = (counts.join(members, cell).groupBy(*key, "path", what).agg(F.sum("n").alias("n")))
    order = Window.partitionBy(*key, "path").orderBy(what)  # at most BLOCKS or FEW rows
    upto = sums.withColumn("end", F.sum("n").over(order))
    return (wanted.join(upto, [*key, "path"])
            .where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
            .withColumn("rank", F.col("rank") - (F.col("end") - F.col("n")))
            .drop("end", "n"))
