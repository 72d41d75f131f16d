"""Exact quantiles of groups that may be too large for one task.

``percentile`` keeps every distinct value of a group in one buffer. For groups bounded by a cycle
that is fine; for whole cells, phases or folds the two passes below are used instead: a sketch
gives bounds that surely enclose the wanted ranks, then only the values between the bounds are
counted per distinct value and the exact, linearly interpolated quantile is read off.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltarc.sources.stages import settled

ACCURACY = 4000


def interpolated(low: Column, high: Column, part: Column) -> Column:
    """Value between two neighbours, counted from the nearer one."""
    return F.when(part >= 0.5, high - (high - low) * (F.lit(1.0) - part)).otherwise(
        low + (high - low) * part)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: ``n`` non-null values and one column per entry of ``probs``.

    The sketch pass runs at once; its few rows per group are written so that the second pass can
    broadcast them if they are small, and leave the data where it is.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    keys = list(keys)
    if not keys:
        data = data.withColumn("_all", F.lit(1))
    groups = keys or ["_all"]
    slack = 3.0 / accuracy
    names = list(probs)
    bounds = F.array(*[
        F.lit(min(max(p + side * slack, 0.0), 1.0)) for p in probs.values() for side in (-1, 1)])
    sketch = data.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", bounds, accuracy).alias("_b"))
    # a small group is enumerated whole: the slack would be less than a few ranks
    small = F.col("n") <= accuracy
    spans = sketch.select(*groups, "n", F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("prob"),
            (F.lit(probs[name]) * (F.col("n") - 1)).alias("rank"),
            F.when(small | F.lit(probs[name] - slack <= 0), F.col("_min"))
            .otherwise(F.col("_b")[2 * i]).alias("lo"),
            F.when(small | F.lit(probs[name] + slack >= 1), F.col("_max"))
            .otherwise(F.col("_b")[2 * i + 1]).alias("hi"))
        for i, name in enumerate(names)])).alias("_s")).select(*groups, "n", "_s.*")
    spans = settled(spans)

    # pass 2: values below the span are only counted; values inside are counted one by one
    span = [*groups, "n", "prob", "rank"]
    within = (data.join(spans, groups)
                  .where(F.col("_v") <= F.col("hi"))
                  .withColumn("_v", F.when(F.col("_v") >= F.col("lo"), F.col("_v")))
                  .groupBy(*span, "_v").agg(F.count(F.lit(1)).alias("_c")))
    order = Window.partitionBy(*span).orderBy(F.col("_v").asc_nulls_first())
    picked = (within.withColumn("_end", F.sum("_c").over(
                  order.rowsBetween(Window.unboundedPreceding, 0)))
              .where(F.col("_v").isNotNull() & (F.col("_end") > F.floor("rank"))
                     & (F.col("_end") - F.col("_c") <= F.ceil("rank")))
              .groupBy(*span)
              .agg(F.min("_v").alias("_at_floor"), F.max("_v").alias("_at_ceil")))
    exact = F.col("_at_floor") + (F.col("_at_ceil") - F.col("_at_floor")) * (
        F.col("rank") - F.floor("rank"))
    out = picked.groupBy(*groups, "n").agg(*[
        F.max(F.when(F.col("prob") == name, exact)).alias(name) for name in names])
    return out if keys else out.drop("_all")
