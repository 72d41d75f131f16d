"""State of health, remaining life and state of charge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed, ordered
from voltarc.operators.cycles import CYCLE, in_cycle
from voltarc.sources.stages import settled


def initial_capacity(cycles: DataFrame, tests: int = 3) -> DataFrame:
    """Median charge of the first capacity tests of each cell."""
    first = Window.partitionBy("cell_id").orderBy("cycleNumber")
    return (cycles.where(F.col("is_capacity_test") & F.col("QDischarge_mAh").isNotNull())
            .select("cell_id", "cycleNumber", "QDischarge_mAh")
            .withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= tests)
            .groupBy("cell_id")
            .agg(F.percentile("QDischarge_mAh", F.lit(0.5)).alias("initial_capacity_mAh")))


def with_soh(cycles: DataFrame) -> DataFrame:
    """``SOH_pct``: measured at capacity tests, linear by row position between them, held flat
    before the first and after the last. Needs ``cycle_pos``."""
    cap = F.col("initial_capacity_mAh")
    measured = F.when(F.col("is_capacity_test"),
                      F.col("QDischarge_mAh") / cap * F.lit(100.0))
    base = (cycles.join(settled(initial_capacity(cycles)), "cell_id", "left")
            .withColumn("_m", measured))
    near = ordered.nearest_known(ordered.number_blocks(base, "cycle_pos"), ["cell_id"],
                                 "cycle_pos", "_m", "_before", "_after")
    lo, hi = F.col("_before"), F.col("_after")
    between = lo["val"] + (hi["val"] - lo["val"]) * (
        (F.col("cycle_pos") - lo["pos"]) / (hi["pos"] - lo["pos"]))
    soh = (F.when(F.col("_m").isNotNull(), F.col("_m"))
           .when(lo.isNull(), hi["val"]).when(hi.isNull(), lo["val"]).otherwise(between))
    return near.withColumn("SOH_pct", soh).drop("_m", "_before", "_after", ordered.BLOCK)


def with_smoothed_soh(cycles: DataFrame, width: int = 5) -> DataFrame:
    """Trailing median over ``width`` cycles."""
    halo = ordered.Halo(cycles, ["cell_id"], "cycle_pos", before=width - 1)
    trailing = halo.window.rowsBetween(-(width - 1), 0)
    return halo.own(halo.rows.withColumn(
        "SOH_pct_smoothed", F.percentile("SOH_pct", F.lit(0.5)).over(trailing)))


def end_of_life(cycles: DataFrame, eol_pct: float = fixed.EOL_PCT) -> DataFrame:
    """Per cell: first cycle and first mission with smoothed SOH below ``eol_pct``, and the last
    cycle and mission."""
    below = F.col("SOH_pct_smoothed") < eol_pct
    return cycles.groupBy("cell_id").agg(
        F.min(F.when(below, F.col("cycleNumber"))).alias("eol_cycle"),
        F.max("cycleNumber").alias("last_cycle"),
        F.min(F.when(below, F.col("mission_id"))).alias("first_eol_mission"),
        F.max("mission_id").alias("last_mission_id"))


def with_cycle_rul(cycles: DataFrame, ends: DataFrame) -> DataFrame:
    """Cycles until the end-of-life cycle, never negative; censored cells count to the last."""
    left = F.when(F.col("eol_cycle").isNotNull(),
                  F.greatest(F.col("eol_cycle") - F.col("cycleNumber"), F.lit(0)))
    return cycles.join(ends, "cell_id").withColumns({
        "RUL_cycles": F.coalesce(left, F.col("last_cycle") - F.col("cycleNumber")).cast("double"),
        "RUL_censored": F.col("eol_cycle").isNull()}).drop("eol_cycle", "last_cycle")


def with_soc(samples: DataFrame, cycles: DataFrame) -> DataFrame:
    """Coulomb counting per cycle, 100 % at the start, clipped to 0-100 after the sum.

    Capacity is SOH times the initial capacity. A missing increment makes the rest of the cycle
    unknown. Both inputs bucketed by (cell, cycle) join and scan without a shuffle.
    """
    needed = cycles.select(*CYCLE, "SOH_pct", "initial_capacity_mAh", "discharge_sign")
    cap = F.when(F.col("initial_capacity_mAh") > 0,
                 F.col("SOH_pct") / F.lit(100.0) * F.col("initial_capacity_mAh"))
    upto = in_cycle().rowsBetween(Window.unboundedPreceding, 0)
    hours = (F.col("time_s") - F.coalesce(F.lag("time_s").over(in_cycle()), F.col("time_s"))
             ) / F.lit(3600.0)
    moved = C.standard_current(F.col("I_mA"), F.col("discharge_sign")) * hours
    total = F.when(F.count_if(F.col("_mAh").isNull()).over(upto) == 0, F.sum("_mAh").over(upto))
    soc = F.lit(100.0) + C.ratio(total, cap) * F.lit(100.0)
    return (samples.join(needed, CYCLE, "left").withColumn("_mAh", moved)
            .withColumn("SOC", C.clip(soc, 0.0, 100.0))
            .drop("_mAh", "SOH_pct", "initial_capacity_mAh", "discharge_sign"))


def cell_metadata(cycles: DataFrame) -> DataFrame:
    """Size and label record of each cell."""
    return cycles.groupBy("cell_id").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cycles"),
        F.count_if("is_capacity_test").alias("n_capacity_tests"),
        F.max("initial_capacity_mAh").alias("initial_capacity_mAh"),
        F.max("RUL_censored").alias("rul_censored"))
