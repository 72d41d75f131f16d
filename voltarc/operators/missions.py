"""Mission features, look-ahead targets and the dictionary-named feature layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed, ordered
from voltarc.operators.segments import SEGMENT

MISSION = ["cell_id", "mission_id"]
FAMILIES = ["flight", "charge", "rest", "transition"]


def of_missions(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("mission_id").isNotNull())


def _median(name: str) -> Column:
    return F.percentile(name, F.lit(0.5))


def family_sum(name: str, family: str) -> Column:
    return F.sum(C.masked(F.col("phase_family") == family, F.col(name)))


def phase_sum(name: str, phase: str) -> Column:
    return F.sum(C.masked(F.col("phase_name") == phase, F.col(name)))


def with_mission_position(missions: DataFrame) -> DataFrame:
    """Dense 0-based ``mission_pos`` by mission number within the cell, and ``n_missions``."""
    blocks = ordered.number_blocks(missions, "mission_id")
    return ordered.with_position(blocks, ["cell_id"], ["mission_id"], "mission_pos",
                                 total="n_missions").drop(ordered.BLOCK)


def with_ahead(missions: DataFrame, value: str, name: str, steps: int = 1) -> DataFrame:
    """``value`` of the mission ``steps`` rows later in the same cell. Needs ``mission_pos``."""
    halo = ordered.Halo(missions, ["cell_id"], "mission_pos", after=steps)
    return halo.own(halo.rows.withColumn(name, F.lead(value, steps).over(halo.window)))


def with_next_soh(missions: DataFrame) -> DataFrame:
    """SOH of the next mission and the drop towards it, never negative."""
    ahead = with_ahead(missions, "SOH_end_pct", "SOH_next_pct")
    return ahead.withColumn("dSOH_drop_pct", C.at_least_zero(
        F.col("SOH_end_pct") - F.col("SOH_next_pct")))


def charge_shares(missions: DataFrame, cc: str, cv: str, cv_energy: str,
                  voltage: float) -> DataFrame:
    """Shares of constant-voltage / constant-current time and the mean-current proxy."""
    total = F.col(cc) + F.col(cv)
    return missions.withColumns({
        "cv_fraction": C.ratio(F.col(cv), total), "cc_fraction": C.ratio(F.col(cc), total),
        "cv_mean_I_A_proxy": C.ratio(F.col(cv_energy) / F.lit(voltage),
                                     F.col(cv) / F.lit(3600.0))})


def mission_features(segments: DataFrame, cv_voltage: float = fixed.CV_VOLTAGE_FEATURES
                     ) -> DataFrame:
    """One row per mission from phase features: sums, medians, shares and next-mission targets."""
    base = of_missions(segments).groupBy(*MISSION).agg(
        F.count("seg_id").alias("n_segments"),
        *[family_sum("duration_s", f).alias(f"dur_{f}_s") for f in FAMILIES],
        family_sum("energy_Wh", "flight").alias("energy_flight_Wh"),
        family_sum("energy_Wh", "charge").alias("energy_charge_Wh"),
        _median("thermal_gain_K_per_W").alias("th_gain_med"),
        F.max("thermal_gain_K_per_W").alias("th_gain_max"),
        _median("vi_slope_R_ohm").alias("R_ohm_med"),
        F.percentile("vi_slope_R_ohm", F.lit(0.9)).alias("R_ohm_p90"),
        _median("ic_centroid_V").alias("ic_centroid_V"),
        _median("ic_spread_V").alias("ic_spread_V"),
        _median("ic_peak1_V").alias("ic_p1_V"),
        _median("ic_peak1_height").alias("ic_p1_h"),
        F.max("SOH_mission_end_pct").alias("SOH_end_pct"),
        phase_sum("duration_s", "CC").alias("cc_duration_s"),
        phase_sum("duration_s", "CV").alias("cv_duration_s"),
        phase_sum("energy_Wh", "CV").alias("cv_energy_Wh"))
    full = base.withColumn("flight_Wh_abs", F.abs("energy_flight_Wh")).withColumn(
        "eff_energy", C.ratio(F.col("flight_Wh_abs"), F.col("energy_charge_Wh")))
    shares = charge_shares(full, "cc_duration_s", "cv_duration_s", "cv_energy_Wh", cv_voltage)
    placed = with_next_soh(with_mission_position(shares))
    return placed.withColumn(
        "is_last_mission", F.col("mission_pos") == F.col("n_missions") - 1)


def dictionary_phase(segments: DataFrame) -> DataFrame:
    """Segment features under the dictionary names. Charge columns are NULL off charge segments,
    discharge columns are NULL off flight segments."""
    name, family = F.col("phase_name"), F.col("phase_family")
    charging, flying = family == "charge", family == "flight"

    def chg(value: Column) -> Column:
        return F.when(charging, value)

    def dis(value: Column) -> Column:
        return F.when(flying, value)

    cc, cv = name == "CC", name == "CV"
    amps = C.standard_current(F.col("mean_I_mA"), F.col("discharge_sign")) / F.lit(1000.0)
    baseline = C.ratio(amps * F.col("duration_s") / F.lit(3600.0), F.col("cap_Ah")) * F.lit(100.0)
    return segments.select(
        *SEGMENT, "mission_id", "phase_name", "phase_family", "cell_condition",
        "SOH_mission_end_pct", "RUL_missions_after_phase",
        charging.cast("int").alias("chg_is_charge_phase"),
        cc.cast("int").alias("chg_is_CC"), cv.cast("int").alias("chg_is_CV"),
        chg(F.col("duration_s")).alias("chg_dur_s"),
        chg(F.col("energy_Wh")).alias("chg_energy_Wh"),
        F.when(cc, F.col("duration_s")).alias("chg_cc_dur_s"),
        F.when(cv, F.col("duration_s")).alias("chg_cv_dur_s"),
        F.when(cv, F.col("energy_Wh")).alias("chg_cv_energy_Wh"),
        chg(F.col("mean_C_rate")).alias("chg_mean_C_rate"),
        chg(F.col("max_C_rate")).alias("chg_max_C_rate"),
        chg(F.col("ic_centroid_V")).alias("chg_ic_centroid_V"),
        chg(F.col("ic_spread_V")).alias("chg_ic_spread_V"),
        chg(F.col("ic_peak1_V")).alias("chg_ic_p1_V"),
        chg(F.col("ic_peak1_height")).alias("chg_ic_p1_h"),
        chg(F.col("vi_slope_R_ohm")).alias("chg_vi_R_ohm"),
        flying.cast("int").alias("dis_is_flight_phase"),
        dis(F.col("duration_s")).alias("dis_dur_s"),
        dis(F.abs("energy_Wh")).alias("dis_energy_Wh_abs"),
        dis(F.col("mean_C_rate")).alias("dis_mean_C_rate"),
        dis(F.col("max_C_rate")).alias("dis_max_C_rate"),
        dis(F.col("ic_centroid_V")).alias("dis_ic_centroid_V"),
        dis(F.col("ic_spread_V")).alias("dis_ic_spread_V"),
        dis(F.col("ic_peak1_V")).alias("dis_ic_p1_V"),
        dis(F.col("ic_peak1_height")).alias("dis_ic_p1_h"),
        dis(F.col("vi_slope_R_ohm")).alias("dis_vi_R_ohm"),
        dis(F.col("delta_SOC")).alias("dis_dSOC"),
        dis(baseline).alias("dis_dSOC_baseline"),
        F.col("mean_temp_C").alias("temp_mean_C"), F.col("max_temp_C").alias("temp_max_C"),
        F.col("thermal_slope_K_per_s").alias("temp_thermal_slope"),
        F.col("thermal_gain_K_per_W").alias("temp_thermal_gain"))


def dictionary_mission(phases: DataFrame, setpoints: DataFrame,
                       cv_voltage: float = fixed.CV_VOLTAGE_FEATURES) -> DataFrame:
    """Mission features under the dictionary names, with running energies per cell.

    ``phases`` is :func:`dictionary_phase`; ``setpoints`` has the charge voltage of each cell.
    """
    def total(name: str) -> Column:
        return F.sum(F.coalesce(F.col(name), F.lit(0.0)))

    base = of_missions(phases).groupBy(*MISSION).agg(
        total("chg_dur_s").alias("chg_total_dur_s"),
        total("chg_cc_dur_s").alias("chg_cc_dur_s"),
        total("chg_cv_dur_s").alias("chg_cv_dur_s"),
        total("chg_energy_Wh").alias("chg_energy_Wh"),
        total("chg_cv_energy_Wh").alias("chg_cv_energy_Wh"),
        total("dis_dur_s").alias("dis_total_dur_s"),
        total("dis_energy_Wh_abs").alias("dis_flight_Wh_abs"),
        _median("dis_mean_C_rate").alias("dis_mean_C_rate_med"),
        F.percentile("dis_max_C_rate", F.lit(0.9)).alias("dis_max_C_rate_p90"),
        _median("dis_vi_R_ohm").alias("dis_vi_R_ohm_med"),
        F.percentile("dis_vi_R_ohm", F.lit(0.9)).alias("dis_vi_R_ohm_p90"),
        total("dis_dSOC").alias("dis_dSOC_sum"),
        total("dis_dSOC_baseline").alias("dis_dSOC_baseline_sum"),
        _median("temp_mean_C").alias("temp_mean_C_med"),
        F.max("temp_max_C").alias("temp_max_C_max"),
        _median("temp_thermal_gain").alias("temp_th_gain_med"),
        F.max("temp_thermal_gain").alias("temp_th_gain_max"),
        F.max("SOH_mission_end_pct").alias("SOH_mission_end_pct"),
        _median("RUL_missions_after_phase").alias("RUL_med"),
        F.max("cell_condition").alias("cell_condition"))
    summed = ordered.running_sums(
        ordered.number_blocks(base, "mission_id"), ["cell_id"], ["mission_id"],
        {"_rows": F.lit(1), "chg_cum_Wh": F.col("chg_energy_Wh"),
         "dis_cum_Wh": F.col("dis_flight_Wh_abs")}
    ).withColumn("mission_pos", F.col("_rows") - 1).drop("_rows", ordered.BLOCK)
    shares = charge_shares(summed, "chg_cc_dur_s", "chg_cv_dur_s", "chg_cv_energy_Wh", cv_voltage)
    return (shares.withColumnsRenamed({"cv_fraction": "chg_cv_fraction",
                                       "cv_mean_I_A_proxy": "chg_cv_mean_I_A_proxy"})
            .drop("cc_fraction")
            .join(setpoints.select("cell_id", "cv_setpoint_V"), "cell_id", "left")
            .withColumn("SOH_end_pct", F.col("SOH_mission_end_pct")))
