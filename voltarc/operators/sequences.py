"""Trailing windows over segments and missions, their labels, scaling, padding and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed, ordered
from voltarc.operators.missions import MISSION, of_missions, with_ahead
from voltarc.operators.tables import model_features, pick_soc_target, quoted, with_conditions


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing feature values become 0."""
    return df.withColumns({f: F.coalesce(quoted(f).cast("double"), F.lit(0.0))
                           for f in features})


def step(features: Sequence[str]) -> Column:
    return F.array(*[quoted(f).cast("double") for f in features])


def soc_rows(phases: DataFrame) -> tuple[DataFrame, list[str]]:
    """Flight segments of missions with filled features, condition columns and ``label``."""
    features = model_features("phase", phases.columns)
    target = pick_soc_target(phases.columns)
    before = set(phases.columns)
    rows = with_conditions(phases)
    features += [c for c in rows.columns if c not in before]
    rows = filled(of_missions(rows).withColumn("label", F.col(target)), features)
    return rows.where(F.col("dis_is_flight_phase") == 1), features


def soc_sequences(rows: DataFrame, features: Sequence[str], steps: int = fixed.SOC_STEPS
                  ) -> DataFrame:
    """Up to ``steps`` flight segments of the mission, one sample from its second segment on."""
    in_mission = Window.partitionBy(*MISSION).orderBy("cycleNumber", "seg_id")
    trailing = in_mission.rowsBetween(-(steps - 1), 0)
    return (rows.withColumn("steps", F.collect_list(step(features)).over(trailing))
            .withColumn("_nth", F.row_number().over(in_mission)).where(F.col("_nth") > 1)
            .select(*MISSION, "seg_id", "steps", F.size("steps").alias("length"), "label"))


def mission_rows(missions: DataFrame) -> tuple[DataFrame, list[str]]:
    """Missions with filled features and condition columns. Needs ``mission_pos``."""
    features = model_features("mission", missions.columns)
    before = set(missions.columns)
    rows = with_conditions(missions)
    features += [c for c in rows.columns if c not in before]
    return filled(rows, features), features


def soh_horizon(missions: DataFrame, horizon: int = fixed.SOH_HORIZON) -> DataFrame:
    """SOH ``horizon`` missions ahead and the drop until then; only missions that have it."""
    last = missions.groupBy("cell_id").agg(F.max("mission_id").alias("_last"))
    ahead = with_ahead(missions, "SOH_end_pct", "SOH_future", horizon)
    return (ahead.join(last, "cell_id").where(F.col("mission_id") <= F.col("_last") - horizon)
            .drop("_last").withColumn("dSOH_to_future", C.at_least_zero(
                F.col("SOH_end_pct") - F.col("SOH_future"))))


def rul_missions(missions: DataFrame, levels: Sequence[int] = tuple(fixed.EOL_SWEEP)
                 ) -> DataFrame:
    """Missions left by row position until SOH falls below each level, else until the last."""
    ends = missions.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(F.when(F.col("SOH_end_pct") < level, F.col("mission_pos"))).alias(f"_e{level}")
          for level in levels])
    pos = F.col("mission_pos")
    per_level = F.explode(F.array(*[F.struct(
        F.lit(level).alias("eol"),
        F.coalesce(F.when(F.col(f"_e{level}").isNotNull(),
                          F.greatest(F.col(f"_e{level}") - pos, F.lit(0))),
                   F.col("_n") - 1 - pos).cast("double").alias("RUL_missions"),
        F.col(f"_e{level}").isNull().alias("RUL_censored")) for level in levels])).alias("_l")
    return (missions.join(ends, "cell_id").select("*", per_level).select("*", "_l.*")
            .drop("_l", "_n", *[f"_e{level}" for level in levels]))


def mission_sequences(rows: DataFrame, features: Sequence[str], label: str,
                      steps: int = fixed.MISSION_STEPS, carry: Sequence[str] = (),
                      keys: Sequence[str] = ()) -> DataFrame:
    """Up to ``steps`` missions of the cell, one sample per mission.

    ``keys`` are further columns (such as the end-of-life level) that separate the sequences.
    """
    halo = ordered.Halo(rows, ["cell_id", *keys], "mission_pos", before=steps - 1)
    trailing = halo.window.rowsBetween(-(steps - 1), 0)
    own = halo.own(halo.rows.withColumn("steps", F.collect_list(step(features)).over(trailing)))
    return own.select(*MISSION, *keys, "mission_pos", *carry, "steps",
                      F.size("steps").alias("length"), F.col(label).alias("label"))


def padded(sequences: DataFrame, steps: int) -> DataFrame:
    """Zero-padded steps of common length and the mask of real steps."""
    zero = F.transform(F.col("steps")[0], lambda x: x * 0.0)
    return sequences.withColumns({
        "padded": F.concat("steps", F.array_repeat(zero, F.lit(steps) - F.col("length"))),
        "mask": F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i <= F.col("length"))})


def last_step(sequences: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features of the last step of each sequence as columns."""
    last = F.element_at("steps", -1)
    return sequences.withColumns({f: last[i] for i, f in enumerate(features)}).drop("steps")


def last_rows(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """What :func:`last_step` gives for trailing windows, without building them: the last step of
    the window that ends at a row is that row."""
    return rows.select(*MISSION, *map(quoted, features), F.col(label).alias("label"))


def window_scaler(rows: DataFrame, features: Sequence[str], keys: Sequence[str], position: str,
                  steps: int, first: int = 0) -> DataFrame:
    """Mean and deviation of each feature over all overlapping windows, without building them.

    A row at position p of n lies in the windows that end at max(p, first) .. min(p+steps-1, n-1);
    that number is its weight. A zero deviation becomes 1.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    p, n = F.col(position), F.col("_n")
    weight = F.least(p + steps - 1, n - 1) - F.greatest(p, F.lit(first)) + 1
    weighed = rows.join(sizes, list(keys)).where(weight > 0)
    long = weighed.select(weight.cast("double").alias("w"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), quoted(f).alias("x")) for f in features])).alias("_p")
    ).select("w", "_p.*")
    means = long.groupBy("feature").agg(
        F.sum("w").alias("n_steps"),
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"))
    gap = F.col("x") - F.col("mean")
    spread = long.join(means.select("feature", "mean"), "feature").groupBy("feature").agg(
        F.sqrt(F.sum(F.col("w") * gap * gap) / F.sum("w")).alias("_sd"))
    return means.join(spread, "feature").select(
        "feature", F.col("n_steps").cast("long").alias("n_steps"), "mean",
        F.when(F.col("_sd") < 1e-12, F.lit(1.0)).otherwise(F.col("_sd")).alias("std"))


POOLS = ["last", "mean", "min", "max", "slope"]


def pooled_long(rows: DataFrame, features: Sequence[str], steps: int = fixed.MISSION_STEPS
                ) -> DataFrame:
    """Each trailing window reduced to last, mean, min, max and slope: one row per mission and
    feature. One narrow window over all features is far cheaper than a wide one per feature."""
    long = rows.select(*MISSION, "mission_pos", F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), quoted(f).alias("last")) for f in features])).alias("_p")
    ).select(*MISSION, "mission_pos", "_p.*")
    halo = ordered.Halo(long, ["cell_id", "feature"], "mission_pos", before=steps - 1)
    trailing = halo.window.rowsBetween(-(steps - 1), 0)
    slope = F.regr_slope("last", F.col("mission_pos").cast("double")).over(trailing)
    return halo.own(halo.rows.withColumns({
        "mean": F.avg("last").over(trailing), "min": F.min("last").over(trailing),
        "max": F.max("last").over(trailing), "slope": F.coalesce(slope, F.lit(0.0))}))


def pooled(rows: DataFrame, features: Sequence[str], steps: int = fixed.MISSION_STEPS
           ) -> DataFrame:
    """:func:`pooled_long` as columns ``<feature>__<pool>`` next to the columns of ``rows``."""
    wide = (pooled_long(rows, features, steps).groupBy(*MISSION)
            .pivot("feature", list(features)).agg(*[F.first(p).alias(f"_{p}") for p in POOLS]))
    return rows.join(wide, MISSION)


def pooled_segments(rows: DataFrame, features: Sequence[str], steps: int = fixed.SOC_STEPS
                    ) -> DataFrame:
    """The flight segments of a mission, as :func:`soc_rows` gives them, with the same pools of the
    segments up to each of them as columns."""
    keys = [*MISSION, "cycleNumber", "seg_id"]
    in_mission = Window.partitionBy(*MISSION).orderBy("cycleNumber", "seg_id")
    long = rows.withColumn("_at", F.row_number().over(in_mission)).select(
        *keys, "_at", F.explode(F.array(*[F.struct(
            F.lit(f).alias("feature"), quoted(f).alias("last")) for f in features])).alias("_p")
    ).select(*keys, "_at", "_p.*")
    trailing = (Window.partitionBy(*MISSION, "feature").orderBy("_at")
                .rowsBetween(-(steps - 1), 0))
    slope = F.regr_slope("last", F.col("_at").cast("double")).over(trailing)
    wide = long.withColumns({
        "mean": F.avg("last").over(trailing), "min": F.min("last").over(trailing),
        "max": F.max("last").over(trailing), "slope": F.coalesce(slope, F.lit(0.0))}
    ).groupBy(*keys).pivot("feature", list(features)).agg(
        *[F.first(p).alias(f"_{p}") for p in POOLS])
    return rows.join(wide, keys)
