"""Phase labels, run-length segments and phase instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.operators.cycles import CYCLE, in_cycle, with_power, with_spacing

SEGMENT = [*CYCLE, "seg_id"]


def label_phases(samples: DataFrame) -> DataFrame:
    return samples.withColumns({
        "phase": C.phase_name(F.col("Ns")), "phase_source": F.lit("Ns")})


def with_segments(samples: DataFrame) -> DataFrame:
    """``seg_id``: run of equal phase codes within a cycle; a missing code never equals another."""
    code = F.col("Ns")
    marked = samples.withColumns({
        "_nth": F.row_number().over(in_cycle()), "_prev": F.lag(code).over(in_cycle())})
    changed = F.when(F.col("_nth") == 1, code.isNull()).otherwise(
        F.coalesce(code != F.col("_prev"), F.lit(True)))
    upto = in_cycle().rowsBetween(Window.unboundedPreceding, 0)
    return (marked.withColumn("seg_id", F.sum(changed.cast("int")).over(upto).cast("int"))
            .drop("_nth", "_prev"))


def segment_energy(samples: DataFrame) -> DataFrame:
    """Energy of each segment in Wh."""
    work = with_segments(with_spacing(with_power(samples)))
    return work.groupBy(*SEGMENT).agg(
        (F.sum(F.col("power_W") * F.col("dt") / F.lit(3600.0))).alias("energy_Wh"))


def segment_totals(samples: DataFrame) -> DataFrame:
    """One row per segment with a phase code: bounds, energy, power, current, temperature, SOC."""
    work = with_segments(with_spacing(with_power(samples)))
    if "SOC" not in work.columns:
        work = work.withColumn("SOC", F.lit(None).cast("double"))
    place = F.when(F.col("SOC").isNotNull(), F.struct("time_s", "sample_id"))
    p, i, temp = F.col("power_W"), F.col("I_mA"), F.col("Temperature__C")
    return work.where(F.col("Ns").isNotNull()).groupBy(*SEGMENT, "Ns").agg(
        F.min("time_s").alias("t_start_s"), F.max("time_s").alias("t_end_s"),
        F.sum("dt").alias("duration_s"),
        F.sum(p * F.col("dt") / F.lit(3600.0)).alias("energy_Wh"),
        F.avg(p).alias("mean_power_W"), F.max(p).alias("max_power_W"),
        F.avg(F.abs(p)).alias("mean_abs_power_W"),
        F.avg(i).alias("mean_I_mA"), F.max(i).alias("max_I_mA"), F.min(i).alias("min_I_mA"),
        F.avg(temp).alias("mean_temp_C"), F.max(temp).alias("max_temp_C"),
        F.min_by("SOC", place).alias("start_SOC"), F.max_by("SOC", place).alias("end_SOC"),
    ).withColumn("phase_name", C.phase_name(F.col("Ns"))).withColumn(
        "phase_family", C.phase_family(F.col("phase_name")))


def with_c_rate(segments: DataFrame) -> DataFrame:
    """Capacity in Ah (SOH times initial, or initial alone) and mean / max C-rate."""
    first = F.col("initial_capacity_mAh") / F.lit(1000.0)
    cap = F.coalesce(F.col("SOH_cycle_pct") / F.lit(100.0) * first, first)
    peak = F.greatest(F.abs("max_I_mA"), F.abs("min_I_mA"))
    return segments.withColumn("cap_Ah", cap).withColumns({
        "mean_C_rate": C.ratio(F.abs("mean_I_mA") / F.lit(1000.0), F.col("cap_Ah")),
        "max_C_rate": C.ratio(peak / F.lit(1000.0), F.col("cap_Ah"))})


def with_phase_order(segments: DataFrame) -> DataFrame:
    """Order of a segment in its mission by start time (a mission lies inside one cycle)."""
    order = Window.partitionBy(*CYCLE).orderBy("t_start_s", "seg_id")
    return segments.withColumn("phase_order_in_mission", F.when(
        F.col("mission_id").isNotNull(), F.row_number().over(order)))


def with_phase_rul(segments: DataFrame) -> DataFrame:
    """Missions left after the segment's mission; censored cells count to their last mission."""
    end = F.coalesce("first_eol_mission", "last_mission_id")
    return segments.withColumns({
        "RUL_missions_after_phase": C.at_least_zero((end - F.col("mission_id")).cast("double")),
        "RUL_missions_censored": F.col("first_eol_mission").isNull()})


def phase_instances(samples: DataFrame, cycles: DataFrame) -> DataFrame:
    """Segments with mission, health, C-rate and remaining-life labels.

    ``samples`` carries SOC; ``cycles`` carries SOH, missions and the end-of-life missions.
    """
    labels = cycles.select(
        *CYCLE, F.coalesce("SOH_pct_smoothed", "SOH_pct").alias("SOH_cycle_pct"),
        "initial_capacity_mAh", "discharge_sign", "mission_id", "first_eol_mission",
        "last_mission_id")
    base = segment_totals(samples).join(labels, CYCLE, "left")
    full = with_phase_rul(with_phase_order(with_c_rate(base)))
    family = F.col("phase_family")
    soh = F.col("SOH_cycle_pct")
    return full.withColumns({
        "is_mission_cycle": F.col("mission_id").isNotNull(),
        "is_charge_phase": family == "charge", "is_flight_phase": family == "flight",
        "is_rest_phase": family == "rest", "is_transition": family == "transition",
        "delta_SOC": F.col("end_SOC") - F.col("start_SOC"),
        "start_SOH_pct": soh, "end_SOH_pct": soh, "delta_SOH_pct": F.lit(0.0),
        "SOH_mission_end_pct": soh,
        "cell_condition": C.cell_condition(F.col("cell_id")),
    }).drop("first_eol_mission", "last_mission_id", "initial_capacity_mAh")


def segment_range_join(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples inside the time bounds (both ends included) of each segment of the same cycle."""
    bounds = segments.select(*SEGMENT, "t_start_s", "t_end_s")
    return samples.join(bounds, CYCLE).where(
        F.col("time_s").between(F.col("t_start_s"), F.col("t_end_s")))
