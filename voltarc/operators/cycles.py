"""Cycle layer: one pass over the samples, then everything else on one row per cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed, ordered
from voltarc.functions.quantiles import group_quantiles
from voltarc.sources.stages import settled

CYCLE = ["cell_id", "cycleNumber"]

FLIGHT_CODES = [4, 5, 6]


def in_cycle():
    """Samples of one cycle in time order."""
    return Window.partitionBy(*CYCLE).orderBy("time_s", "sample_id")


def with_power(samples: DataFrame) -> DataFrame:
    return samples.withColumn("power_W", C.power_w(F.col("Ecell_V"), F.col("I_mA")))


def with_spacing(samples: DataFrame) -> DataFrame:
    """``dt``: seconds since the previous sample of the cycle, first 0, never negative."""
    gap = F.col("time_s") - F.lag("time_s").over(in_cycle())
    return samples.withColumn("dt", F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)))


def column_profile(samples: DataFrame, required=tuple(fixed.REQUIRED_RAW), limit: float = 0.5,
                   keys=("cell_id",)) -> DataFrame:
    """Per cell and column: share of missing values, distinct count and the drop decision.

    A column is dropped when it is constant (a missing value counts as a value) or when more than
    ``limit`` of it is missing, unless it is required.
    """
    names = [c for c in samples.columns if c not in keys]
    aggs = []
    for c in names:
        # constant means: at most one distinct value with missing counted, so min = max decides
        aggs += [F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__miss"),
                 F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    wide = samples.groupBy(*keys).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{c}__miss").alias("missing_share"),
        (F.col(f"{c}__max").isNull()
         | ((F.col(f"{c}__miss") == 0) & (F.col(f"{c}__min") == F.col(f"{c}__max")))
         ).alias("is_constant"),
        F.lit(c in required).alias("is_required")) for c in names])).alias("p")
    return wide.select(*keys, rows).select(*keys, "p.*").withColumn(
        "is_dropped", ~F.col("is_required")
        & (F.col("is_constant") | (F.col("missing_share") > limit)))


def drop_uninformative(samples: DataFrame, required=tuple(fixed.REQUIRED_RAW),
                       limit: float = 0.5, keys=("cell_id", "sample_id")) -> DataFrame:
    """Drops the columns that :func:`column_profile` marks in every cell (one small collect)."""
    profile = column_profile(samples.drop(*[k for k in keys if k != "cell_id"]), required, limit)
    doomed = (profile.groupBy("column_name").agg(F.min("is_dropped").alias("all_cells"))
              .where("all_cells").select("column_name"))
    return samples.drop(*[r[0] for r in doomed.collect()])  # at most one row per column


def cycle_facts(samples: DataFrame) -> DataFrame:
    """All per-cycle sums in one pass over the samples; both current directions are kept."""
    t, v, i, q = F.col("time_s"), F.col("Ecell_V"), F.col("I_mA"), F.col("QDischarge_mA_h")
    work = with_power(with_spacing(samples)).withColumns({
        "_jump": F.abs(v - F.lag(v).over(in_cycle())),
        "_up": F.coalesce(q - F.lag(q).over(in_cycle()) > 0, F.lit(False))})
    code = F.col("Ns")
    place = F.struct("time_s", "sample_id")
    energy = {name: (F.max(source) if source in samples.columns else F.lit(None).cast("double"))
              for name, source in (("energy_discharge", "EnergyDischarge_W_h"),
                                   ("energy_charge", "EnergyCharge_W_h"))}
    sides = []
    for side, mask in (("pos", i > fixed.REST_CURRENT_MA), ("neg", i < -fixed.REST_CURRENT_MA)):
        sides += [F.coalesce(F.sum(F.when(mask, F.col("dt"))), F.lit(0.0)).alias(f"{side}_dur_s"),
                  F.stddev_samp(F.when(mask, i)).alias(f"{side}_std"),
                  F.avg(F.when(mask, i)).alias(f"{side}_mean")]
    return work.groupBy(*CYCLE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.max(t) - F.min(t)).alias("duration_s"),
        F.max(v).alias("max_voltage"), F.min(v).alias("min_voltage"),
        F.avg(v).alias("mean_voltage"),
        F.max("Temperature__C").alias("max_temp"), F.avg("Temperature__C").alias("mean_temp"),
        F.max(i).alias("max_current"), F.avg(i).alias("mean_current"),
        F.stddev_samp(i).alias("std_current"),
        F.max("power_W").alias("max_power"), F.avg("power_W").alias("mean_power"),
        F.max(q).alias("QDischarge_mAh"), F.max("QCharge_mA_h").alias("QCharge_mAh"),
        *[expr.alias(name) for name, expr in energy.items()],
        F.coalesce(F.mode(code, deterministic=True), F.lit(-1)).alias("Ns_mode"),
        F.avg(F.coalesce(code.isin(FLIGHT_CODES), F.lit(False)).cast("double")
              ).alias("frac_flight"),
        *sides,
        F.max("_jump").alias("max_jump_V"),
        F.coalesce(F.bool_or(code == 4) & F.bool_or(code == 6), F.lit(False)).alias("is_mission"),
        F.min_by(q, place).alias("q_first"), F.max_by(q, place).alias("q_last"),
        F.min_by(i, place).alias("i_first"),
        F.count_if("_up").alias("up_rows"),
        F.count(F.when(F.col("_up"), i)).alias("up_n"),
        F.sum(F.when(F.col("_up"), i)).alias("up_sum"))


SUMMARY = [*CYCLE, "n_rows", "duration_s", "max_voltage", "min_voltage", "mean_voltage",
           "max_temp", "mean_temp", "max_current", "mean_current", "std_current", "max_power",
           "mean_power", "QDischarge_mAh", "QCharge_mAh", "energy_discharge", "energy_charge",
           "Ns_mode"]


def cycle_summary(facts: DataFrame) -> DataFrame:
    return facts.select(*SUMMARY)


def with_cycle_position(facts: DataFrame) -> DataFrame:
    """Dense 0-based ``cycle_pos`` of each cycle in its cell, and ``mission_id``: 1..n over the
    cycles that hold take-off and landing, NULL elsewhere."""
    counted = ordered.running_sums(
        ordered.number_blocks(facts, "cycleNumber"), ["cell_id"], ["cycleNumber"],
        {"_rows": F.lit(1), "_missions": F.col("is_mission").cast("long")})
    return counted.withColumns({
        "cycle_pos": F.col("_rows") - 1,
        "mission_id": F.when(F.col("is_mission"), F.col("_missions").cast("int")),
    }).drop("_rows", "_missions", ordered.BLOCK)


def discharge_sign(facts: DataFrame, samples: DataFrame, min_rows: int = 10) -> DataFrame:
    """+1 where discharge is logged as positive current, else -1; one row per cell.

    Mean current over samples whose discharge counter rose, cycle borders included. Cells with
    fewer than ``min_rows`` such samples use the sign of their median current.
    """
    halo = ordered.Halo(facts, ["cell_id"], "cycle_pos", before=1)
    border = F.coalesce(
        F.col("q_first") - F.lag("q_last").over(halo.window) > 0, F.lit(False))
    rows = halo.own(halo.rows.withColumn("_border", border))
    rising = rows.groupBy("cell_id").agg(
        F.sum(F.col("up_rows") + F.col("_border").cast("long")).alias("rising_rows"),
        F.sum(F.coalesce(F.col("up_sum"), F.lit(0.0))
              + F.when(F.col("_border"), F.coalesce("i_first", F.lit(0.0))).otherwise(F.lit(0.0))
              ).alias("_sum"),
        F.sum(F.col("up_n") + (F.col("_border") & F.col("i_first").isNotNull()).cast("long")
              ).alias("_n"))
    rising = settled(rising)
    few = settled(rising.where(F.col("rising_rows") < min_rows).select("cell_id"))
    medians = group_quantiles(samples.join(few, "cell_id", "left_semi"), ["cell_id"], "I_mA",
                              {"median_mA": 0.5}).drop("n")
    mean = C.ratio(F.col("_sum"), F.col("_n"))
    basis = F.when(F.col("rising_rows") < min_rows, F.col("median_mA")).otherwise(mean)
    return rising.join(medians, "cell_id", "left").select(
        "cell_id", "rising_rows",
        F.when(basis > 0, F.lit(1)).otherwise(F.lit(-1)).alias("discharge_sign"))


def capacity_features(facts: DataFrame, signs: DataFrame) -> DataFrame:
    """Evidence for a capacity test: flight share, discharge time, steadiness, charge, voltage."""
    positive = F.col("discharge_sign") > 0

    def side(name: str) -> Column:
        return F.when(positive, F.col(f"pos_{name}")).otherwise(F.col(f"neg_{name}"))

    steady = side("std") / (F.abs(side("mean")) + F.lit(1e-6)) <= F.lit(0.30)
    return facts.join(signs.select("cell_id", "discharge_sign"), "cell_id").withColumns({
        "dis_dur_s": side("dur_s"),
        "quasi_cc": F.coalesce(steady, F.lit(False)),
        "vdrop": C.at_least_zero(F.col("max_voltage") - F.col("min_voltage"))})


def score_cycles(features: DataFrame) -> DataFrame:
    """``score`` 0-5: one point per sign of a capacity test."""
    cell = ["cell_id"]
    long = features.select("cell_id", F.explode(F.array(
        F.struct(F.lit("dur").alias("of"),
                 F.when(F.col("frac_flight") > 0.2, F.col("dis_dur_s")).alias("x")),
        F.struct(F.lit("charge").alias("of"), F.col("QDischarge_mAh").alias("x")))).alias("_p")
    ).select("cell_id", "_p.*")
    marks = group_quantiles(long, ["cell_id", "of"], "x", {"_50": 0.5, "_90": 0.9, "_100": 1.0})
    is_dur = F.col("of") == "dur"
    marks = marks.groupBy("cell_id").agg(
        F.max(F.when(is_dur, F.col("_50"))).alias("_mission_dur"),
        F.max(F.when(~is_dur, F.col("_90"))).alias("_q90"),
        F.max(F.when(~is_dur, F.col("_100"))).alias("_qmax"))
    limit = F.greatest(F.lit(1200.0), F.lit(1.8) * F.coalesce("_mission_dur", F.lit(800.0)))
    tests = [
        F.col("frac_flight") < 0.02,
        F.col("dis_dur_s") > limit,
        F.col("QDischarge_mAh") >= F.greatest(F.col("_q90"), F.lit(0.9) * F.col("_qmax")),
        F.col("quasi_cc"),
        (F.col("min_voltage") <= 3.0) | (F.col("vdrop") >= 0.8),
    ]
    score = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return (features.join(settled(marks), cell, "left").withColumn("score", score)
            .drop("_mission_dur", "_q90", "_qmax"))


def _best_first():
    return Window.partitionBy("cell_id").orderBy(
        F.desc("score"), F.desc_nulls_last("QDischarge_mAh"), F.asc("cycleNumber"))


def flag_capacity_tests(scored: DataFrame, min_score: int = 3, fallback: int = 2) -> DataFrame:
    """``is_capacity_test``: score of at least ``min_score``; a cell without any takes its best
    ``fallback`` cycles among those without flight."""
    found = settled(scored.groupBy("cell_id").agg(
        F.max(F.col("score") >= min_score).alias("_found")))
    flagged = scored.join(found, "cell_id")
    # the rank limit is applied before the shuffle, so a hot cell sends only a few rows
    picks = (flagged.where(~F.col("_found") & (F.col("frac_flight") < 0.02))
             .select(*CYCLE, "score", "QDischarge_mAh")
             .withColumn("_rank", F.row_number().over(_best_first()))
             .where(F.col("_rank") <= fallback).select(*CYCLE, F.lit(True).alias("_picked")))
    return (flagged.join(picks, CYCLE, "left")
            .withColumn("is_capacity_test", (F.col("score") >= min_score)
                        | F.coalesce("_picked", F.lit(False)))
            .drop("_found", "_picked"))


def attach_capacity_flags(summary: DataFrame, tests: DataFrame) -> DataFrame:
    """Cycle summary with the capacity columns; a cycle without evidence is not a test."""
    wanted = tests.select(*CYCLE, "is_capacity_test", "score", "dis_dur_s", "frac_flight")
    return summary.join(wanted, CYCLE, "left").withColumn(
        "is_capacity_test", F.coalesce("is_capacity_test", F.lit(False)))


def capacity_candidates(tests: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` cycles of each cell by score."""
    order = Window.partitionBy("cell_id").orderBy(F.desc("score"), "cycleNumber")
    return (tests.select(*CYCLE, "score", "dis_dur_s", "frac_flight", "QDischarge_mAh")
            .withColumn("candidate_rank", F.row_number().over(order))
            .where(F.col("candidate_rank") <= top))


def with_anomalies(cycles: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``anomaly_score``: voltage out of range, too short a cycle, voltage jump; one point each.

    ``facts`` is the table the typical duration is read from (default ``cycles`` itself).
    """
    typical = group_quantiles(cycles if facts is None else facts, ["cell_id"], "duration_s",
                              {"_typical": 0.5}).drop("n")
    checks = [
        (F.col("min_voltage") < fixed.VOLTAGE_LOW) | (F.col("max_voltage") > fixed.VOLTAGE_HIGH),
        F.col("duration_s") < F.lit(0.1) * F.greatest(
            F.lit(1.0), F.coalesce("_typical", F.lit(0.0))),
        F.col("max_jump_V") > fixed.VOLTAGE_JUMP,
    ]
    score = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    return (cycles.join(settled(typical), "cell_id", "left").withColumn("anomaly_score", score)
            .withColumn("any_anomaly", F.col("anomaly_score") > 0).drop("_typical"))


def cell_checks(telemetry: DataFrame, cycles: DataFrame) -> DataFrame:
    """Can later stages use a cell? ``reason`` is NULL when they can.

    Cells without cycle rows are found by the left join; the rest are counts per cell.
    """
    raw = telemetry.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_samples"), *[F.count(c).alias(c) for c in fixed.REQUIRED_RAW])
    table = cycles.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("_cycles"),
        F.count_if("is_capacity_test").alias("_tests"))
    empty = F.concat_ws(" ", *[F.when(F.col(c) == 0, F.lit(c)) for c in fixed.REQUIRED_RAW])
    checks = raw.join(table, "cell_id", "left")
    return checks.select(
        "cell_id", "n_samples", F.coalesce("_cycles", F.lit(0)).alias("n_cycles"),
        F.coalesce("_tests", F.lit(0)).alias("n_capacity_tests"),
        F.when(F.length(empty) > 0, F.concat(F.lit("no values in "), empty))
        .when(F.col("_cycles").isNull(), "no cycle summary")
        .when(F.col("_tests") == 0, "no capacity test").alias("reason"))


def rejected_cells(telemetry: DataFrame, cycles: DataFrame) -> DataFrame:
    """``(cell_id, reason)`` of the cells to skip."""
    return cell_checks(telemetry, cycles).where(F.col("reason").isNotNull()).select(
        "cell_id", "reason")
