"""Exploration tables: phase stress, mission degradation, correlations, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed, ordered
from voltarc.functions.quantiles import group_quantiles
from voltarc.operators.missions import (FAMILIES, MISSION, charge_shares, family_sum, of_missions,
                                        phase_sum, with_mission_position, with_next_soh)
from voltarc.operators.physics import with_thermal


def phase_stress(segments: DataFrame) -> DataFrame:
    """Count, median duration and energy, mean C-rate and mean peak temperature per phase."""
    kept = segments.where(F.col("duration_s") >= fixed.MIN_SEGMENT_S)
    base = kept.groupBy("phase_name").agg(
        F.count("seg_id").alias("n"), F.avg("mean_C_rate").alias("mean_mean_C"),
        F.avg("max_temp_C").alias("mean_max_T"))
    values = {"duration_s": "median_dur_s", "energy_Wh": "median_energy_Wh"}
    long = kept.select("phase_name", F.explode(F.array(*[
        F.struct(F.lit(name).alias("of"), F.col(value).alias("x"))
        for value, name in values.items()])).alias("_p")).select("phase_name", "_p.*")
    medians = group_quantiles(long, ["phase_name", "of"], "x", {"median": 0.5})
    wide = medians.groupBy("phase_name").agg(*[
        F.max(F.when(F.col("of") == name, F.col("median"))).alias(name)
        for name in values.values()])
    return base.join(wide, "phase_name", "left").select(
        "phase_name", "n", "median_dur_s", "median_energy_Wh", "mean_mean_C", "mean_max_T"
    ).orderBy(F.desc("n"), "phase_name")


def mission_table(segments: DataFrame, compat: bool = False) -> DataFrame:
    """Energies per family, durations per phase, temperature, C-rate and next-mission SOH drop.

    ``compat=True`` reports 0 for the pre-charge rest, as a misspelt phase name once did.
    """
    rest2 = F.lit(0.0) if compat else phase_sum("duration_s", "Rest2 (pre-charge)")
    base = of_missions(segments).groupBy(*MISSION).agg(
        F.count("seg_id").alias("n_segments"),
        *[family_sum("energy_Wh", f).alias(f"energy_{f}_Wh") for f in FAMILIES],
        phase_sum("duration_s", "Take-off").alias("dur_takeoff_s"),
        phase_sum("duration_s", "Cruise").alias("dur_cruise_s"),
        phase_sum("duration_s", "Landing").alias("dur_landing_s"),
        phase_sum("duration_s", "CC").alias("dur_cc_s"),
        phase_sum("duration_s", "CV").alias("dur_cv_s"),
        phase_sum("duration_s", "Rest1 (post-landing)").alias("dur_rest1_s"),
        F.max(rest2).alias("dur_rest2_s") if compat else rest2.alias("dur_rest2_s"),
        F.avg("mean_temp_C").alias("mean_temp_C"), F.max("max_temp_C").alias("max_temp_C"),
        F.avg("mean_C_rate").alias("mean_C_rate"), F.max("max_C_rate").alias("max_C_rate"),
        F.max("SOH_mission_end_pct").alias("SOH_end_pct"))
    return (with_next_soh(with_mission_position(base))
            .withColumn("flight_Wh_abs", F.abs("energy_flight_Wh"))
            .drop("mission_pos", "n_missions"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str,
                  weight: str | None = None) -> DataFrame:
    """``keys, value -> name``: average rank of each distinct value within its keys. ``weight``
    names the number of rows that a row stands for, one each without it.

    Equal values are counted first, so the ranks run over distinct values only; those are cut
    into ranges that follow the data and the totals of earlier ranges are carried over.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")))
    blocks = ordered.range_blocks(counts, [*keys, value])
    ends = ordered.running_sums(blocks, keys, [value], {"_end": F.col("_c")})
    return ends.select(*keys, value, (F.col("_end") - (F.col("_c") - 1) / F.lit(2.0)).alias(name))


def dsoh_spearman(missions: DataFrame, features=tuple(fixed.DSOH_FEATURES),
                  target: str = "dSOH_drop_pct", min_rows: int = 5) -> DataFrame:
    """Rank correlation of mission features with the SOH drop towards the next mission.

    The target is ranked over all rows that have it; a feature is ranked over its own values.
    Missions with equal feature and target are counted before anything else, so the joins with the
    ranks and the moments run over the distinct pairs: ties, such as a target of 0.0, are one row.
    """
    kept = missions.where(F.col(target).isNotNull())
    cells = kept.select(target, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
        for f in features])).alias("_p")).groupBy(target, "_p.feature", "_p.x").agg(
        F.count(F.lit(1)).alias("_w"))
    x_rank = average_ranks(cells, ["feature"], "x", "x_rank", "_w")
    y_rank = average_ranks(kept.withColumn("all", F.lit(1)), ["all"], target, "y_rank"
                           ).drop("all")
    ranked = cells.join(y_rank, target).join(x_rank, ["feature", "x"], "left")
    x, w = F.col("x_rank"), F.when(F.col("x_rank").isNotNull(), F.col("_w"))
    y = F.when(x.isNotNull(), F.col("y_rank"))
    out = ranked.groupBy("feature").agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("n"),
        *[F.sum(w * v).alias(name) for name, v in
          (("_x", x), ("_y", y), ("_xx", x * x), ("_xy", x * y), ("_yy", y * y))],
        ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("_varies"))
    n = F.col("n")
    part = lambda ab, a, b: n * F.col(ab) - F.col(a) * F.col(b)
    r = part("_xy", "_x", "_y") / F.sqrt(part("_xx", "_x", "_x") * part("_yy", "_y", "_y"))
    return out.select("feature", F.when(F.col("_varies") & (n >= min_rows), r)
                      .alias("spearman_r"), "n")


def phase_degradation(segments: DataFrame) -> DataFrame:
    return with_thermal(segments).select(
        "cell_id", "mission_id", "cycleNumber", "seg_id", "phase_name", "phase_family",
        "duration_s", "energy_Wh", "delta_SOC", "mean_abs_power_W", "mean_temp_C", "max_temp_C",
        "mean_C_rate", "max_C_rate", "thermal_slope_K_per_s", "thermal_gain_K_per_W")


def charge_acceptance(segments: DataFrame, cv_voltage: float = fixed.CV_VOLTAGE_EXPLORATION
                      ) -> DataFrame:
    """Constant-current and constant-voltage sums of each mission that has either, in one pass."""
    def part(phase: str, tag: str) -> list:
        def of(name: str):
            return F.when(F.col("phase_name") == phase, F.col(name))

        return [F.sum(of("duration_s")).alias(f"{tag}_duration_s"),
                F.sum(of("energy_Wh")).alias(f"{tag}_energy_Wh"),
                F.avg(of("mean_C_rate")).alias(f"{tag}_mean_C")]

    rows = of_missions(segments).where(F.col("phase_name").isin("CC", "CV"))
    both = rows.groupBy(*MISSION).agg(*part("CC", "cc"), *part("CV", "cv"))
    return charge_shares(both, "cc_duration_s", "cv_duration_s", "cv_energy_Wh", cv_voltage)


def family_energy(segments: DataFrame) -> DataFrame:
    """Energy and duration per family and mission, with energy efficiency."""
    base = of_missions(segments).groupBy(*MISSION).agg(
        *[family_sum("energy_Wh", f).alias(f"energy_{f}_Wh") for f in FAMILIES],
        *[family_sum("duration_s", f).alias(f"dur_{f}_s") for f in FAMILIES])
    return base.withColumn("eff_energy", C.ratio(
        F.abs("energy_flight_Wh"), F.col("energy_charge_Wh")))


def mission_degradation(segments: DataFrame, cv_voltage: float = fixed.CV_VOLTAGE_EXPLORATION
                        ) -> DataFrame:
    """Charge acceptance and family energy of each mission with its health labels."""
    labels = of_missions(segments).groupBy(*MISSION).agg(
        F.max("SOH_mission_end_pct").alias("SOH_mission_end_pct"),
        F.max("RUL_missions_after_phase").alias("RUL_missions_after_phase"),
        F.max("RUL_missions_censored").alias("RUL_missions_censored"))
    return (charge_acceptance(segments, cv_voltage)
            .join(family_energy(segments), MISSION, "full").join(labels, MISSION, "left"))


def phase_box_stats(degradation: DataFrame, features=tuple(fixed.BOX_FEATURES)) -> DataFrame:
    """Quartiles and whiskers (last value within 1.5 quartile ranges) per phase and feature."""
    long = degradation.select("phase_name", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("_p")
    ).select("phase_name", "_p.*").where(F.col("x").isNotNull())
    keys = ["phase_name", "feature"]
    quart = group_quantiles(long, keys, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    whiskers = long.join(quart, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("x") >= F.col("q1") - reach, F.col("x"))).alias("_lo"),
        F.max(F.when(F.col("x") <= F.col("q3") + reach, F.col("x"))).alias("_hi"))
    return quart.join(whiskers, keys).select(
        *keys, "n", "q1", "median", "q3",
        F.least("_lo", "q1").alias("whisker_low"), F.greatest("_hi", "q3").alias("whisker_high"))


def mission_histograms(degradation: DataFrame, features=tuple(fixed.HISTOGRAM_FEATURES),
                       bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram per feature; the last bin includes the maximum."""
    long = degradation.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("_p")
    ).select("_p.*").where(F.col("x").isNotNull())
    spans = long.groupBy("feature").agg(F.min("x").alias("_a"), F.max("x").alias("_b")).select(
        "feature",
        F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("lo"),
        F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("hi"))
    place = F.floor((F.col("x") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo")))
    counts = (long.join(spans, "feature")
              .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
              .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")))
    slots = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return slots.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def first_phases(degradation: DataFrame, limit: int = 12) -> DataFrame:
    """The first ``limit`` distinct phases in order of appearance (a plot selection)."""
    seen = degradation.groupBy("phase_name").agg(
        F.min(F.struct("cell_id", "cycleNumber", "seg_id")).alias("_first"))
    return seen.orderBy("_first").limit(limit).select("phase_name")


def phase_trends(degradation: DataFrame) -> DataFrame:
    """Median thermal gain and SOC change per cell, phase and mission."""
    return of_missions(degradation).groupBy("cell_id", "phase_name", "mission_id").agg(
        F.percentile("thermal_gain_K_per_W", F.lit(0.5)).alias("med_gain"),
        F.percentile("delta_SOC", F.lit(0.5)).alias("med_dsoc"),
        F.count("seg_id").alias("n"))


def capacity_fade(cycles: DataFrame, eol_pct: float = fixed.EOL_PCT) -> DataFrame:
    """Capacity-test charge, SOH and the below-EOL flag of each cycle."""
    soh = F.coalesce("SOH_pct_smoothed", "SOH_pct")
    return cycles.select(
        "cell_id", "cycleNumber", "is_capacity_test",
        F.when(F.col("is_capacity_test"), F.col("QDischarge_mAh")).alias("capacity_mAh"),
        soh.alias("SOH_pct"), (soh < eol_pct).alias("below_eol"))
