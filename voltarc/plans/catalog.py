"""The query catalog: every operator as a named query, with the SQL it is checked against.

A query is a function of the pipeline plus one output list that both sides project:
``name`` is kept; ``*name`` and ``~name`` are rounded to 6 and 3 digits, because sums of doubles
depend on the order of addition; ``+name`` is a nullable integer shown as double. A guard far
below the last digit makes decimal ties round the same way whatever that order was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed
from voltarc.operators import cycles as cy
from voltarc.operators import (exploration, folds, health, missions, models, physics, predictions,
                               segments, sequences, tables)
from voltarc.plans import oracle
from voltarc.plans.pipeline import Pipeline, pipeline
from voltarc.sources import ragged, stages, telemetry

KEY = "cell_id cycleNumber"
SEG = "cell_id cycleNumber seg_id"
MIS = "cell_id mission_id"


@dataclass(frozen=True)
class Query:
    run: Callable[[Pipeline], DataFrame]
    columns: str
    source: str | None  # FROM clause of the SQL, None where SQL cannot express the query

    def spark(self, p: Pipeline) -> DataFrame:
        def shown(token: str):
            name, digits = _split(token)
            col = F.col(f"`{name}`")
            if digits is None:
                return col
            # + 0.0 turns -0.0 into 0.0
            return (F.round(col.cast("double") + F.lit(_guard(digits)), digits) + F.lit(0.0)
                    ).alias(name)

        return self.run(p).select(*map(shown, self.columns.split()))

    def sql(self) -> str | None:
        def shown(token: str) -> str:
            name, digits = _split(token)
            return (f'"{name}"' if digits is None else
                    f'round(CAST("{name}" AS DOUBLE) + {_guard(digits)!r}, {digits}) + 0e0'
                    ) + f' AS "{name}"'

        if self.source is None:
            return None
        return oracle.statement(
            f"SELECT {', '.join(map(shown, self.columns.split()))} FROM {self.source}")


MARKS = {"*": 6, "~": 3, "+": 0}


def _guard(digits: int) -> float:
    return 10.0 ** -(digits + 4)


def _split(token: str) -> tuple[str, int | None]:
    return (token[1:], MARKS[token[0]]) if token[0] in MARKS else (token, None)


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, source: str | None):
    def register(run):
        QUERIES[name] = Query(run, columns, source)
        return run
    return register


# ---------------------------------------------------------------- sources and sinks

SAMPLE = ("sample_id cell_id cycleNumber +Ns time_s *Ecell_V *I_mA *Temperature__C "
          "*QDischarge_mA_h *QCharge_mA_h")


@query("scan_telemetry", SAMPLE, "c_tele")
def scan_telemetry(p):
    """Telemetry written as CSV per cell, then scanned back with the declared schema."""
    path = p.store.path("raw_csv")
    order = [f.name for f in telemetry.RAW_SCHEMA] + ["sample_id", "cell_id"]
    stages.write_table(p.telemetry.select(*order), path, fmt="csv", mode="overwrite")
    return telemetry.read_telemetry(p.spark, f"{path}/*VAH*/*.csv")


def _counts_sql(dataset: str, source: str, names: list[str], absent: list[str] = ()) -> str:
    rows = [f"SELECT '{dataset}' AS dataset, '{n}' AS column_name, "
            + ("CAST(0 AS BIGINT) AS n_values, true AS is_missing" if n in absent else
               f'count("{n}") AS n_values, false AS is_missing FROM {source}') for n in names]
    return " UNION ALL ".join(rows)


ENERGY = ["EnergyDischarge_W_h", "EnergyCharge_W_h"]
oracle.PARTS["c_required"] = " UNION ALL ".join([
    _counts_sql("telemetry", "c_tele", fixed.REQUIRED_RAW + ENERGY, ENERGY),
    _counts_sql("samples", "c_soc", fixed.REQUIRED_SAMPLES),
    _counts_sql("cycles", "c_cycles", fixed.REQUIRED_CYCLES)])


@query("required_columns", "dataset column_name n_values is_missing", "c_required")
def required_columns(p):
    return telemetry.required_columns({
        "telemetry": (p.telemetry, fixed.REQUIRED_RAW + ENERGY),
        "samples": (p.samples(), fixed.REQUIRED_SAMPLES),
        "cycles": (p.cycles, fixed.REQUIRED_CYCLES)})


@query("pruned_scan", "cell_id time_s *Ecell_V *I_mA *Temperature__C cycleNumber +Ns power_W SOC",
       "(SELECT * EXCLUDE (power_W), CAST(NULL AS DOUBLE) AS power_W, "
       "CAST(NULL AS DOUBLE) AS SOC FROM c_smp)")
def pruned_scan(p):
    return telemetry.pruned_scan(p.telemetry)


@query("load_stage", f"{KEY} n_rows *SOH_pct RUL_cycles", "c_cycles")
def load_stage(p):
    """A stage written with padded column names and reloaded with trimmed ones."""
    path = p.store.path("padded_cycles")
    p.cycles.toDF(*[f" {c} " for c in p.cycles.columns]).write.mode("overwrite").parquet(path)
    return telemetry.trimmed(p.spark.read.parquet(path))


@query("sink_roundtrip", f"{SEG} phase_name *energy_Wh *end_SOC +mission_id", "c_phases")
def sink_roundtrip(p):
    path = p.store.path("phases_by_cell")
    stages.write_table(p.phases, path, mode="overwrite")
    return stages.read_tables(p.spark, [path])


@query("union_cells", f"{SEG} phase_name *start_SOC *energy_Wh",
       "(SELECT * EXCLUDE (start_SOC), CASE WHEN cell_id >= 'VAH05' THEN start_SOC END "
       "AS start_SOC FROM c_phases)")
def union_cells(p):
    """Two tables of different columns, combined by name."""
    old, new = p.store.path("cells_old"), p.store.path("cells_new")
    stages.write_table(p.phases.where("cell_id < 'VAH05'").drop("start_SOC"), old,
                       mode="overwrite")
    stages.write_table(p.phases.where("cell_id >= 'VAH05'"), new, mode="overwrite")
    return stages.read_tables(p.spark, [old, new])


query("cell_metadata", "cell_id n_rows n_cycles n_capacity_tests *initial_capacity_mAh "
      "rul_censored",
      "(SELECT cell_id, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_cycles, "
      "count(*) FILTER (WHERE is_capacity_test) AS n_capacity_tests, "
      "max(initial_capacity_mAh) AS initial_capacity_mAh, bool_or(RUL_censored) AS rul_censored "
      "FROM c_cycles GROUP BY cell_id)")(lambda p: health.cell_metadata(p.cycles))

query("rejected_cells", "cell_id n_samples n_cycles n_capacity_tests reason",
      "(SELECT t.cell_id, t.n_samples, coalesce(y.n_cycles, 0) AS n_cycles, "
      "coalesce(y.n_capacity_tests, 0) AS n_capacity_tests, CASE WHEN y.cell_id IS NULL "
      "THEN 'no cycle summary' WHEN y.n_capacity_tests = 0 THEN 'no capacity test' END AS reason "
      "FROM (SELECT cell_id, count(*) AS n_samples FROM c_tele GROUP BY cell_id) t "
      "LEFT JOIN (SELECT cell_id, count(*) AS n_cycles, count(*) FILTER (WHERE is_capacity_test) "
      "AS n_capacity_tests FROM c_cycles WHERE NOT RUL_censored GROUP BY cell_id) y "
      "ON y.cell_id = t.cell_id)")(
    lambda p: cy.cell_checks(p.telemetry, p.cycles.where(~F.col("RUL_censored"))))
query("skipped_cells", "cell_id reason",
      "(SELECT DISTINCT t.cell_id, CASE WHEN y.cell_id IS NULL THEN 'no cycle summary' "
      "ELSE 'no capacity test' END AS reason FROM c_tele t LEFT JOIN "
      "(SELECT cell_id, bool_or(is_capacity_test) AS tested FROM c_cycles "
      "WHERE NOT RUL_censored GROUP BY cell_id) y ON y.cell_id = t.cell_id "
      "WHERE y.cell_id IS NULL OR NOT y.tested)")(
    lambda p: cy.rejected_cells(p.telemetry, p.cycles.where(~F.col("RUL_censored"))))

# ---------------------------------------------------------------- samples

query("power", f"sample_id {KEY} *power_W", "c_smp")(lambda p: cy.with_power(p.telemetry))
query("sample_dt", f"sample_id {KEY} dt", "c_smp")(lambda p: cy.with_spacing(p.telemetry))
query("segments", f"sample_id {SEG} +Ns", "c_seg")(lambda p: segments.with_segments(p.telemetry))
query("label_phases", f"sample_id {KEY} +Ns phase phase_source", "c_soc")(
    lambda p: segments.label_phases(p.telemetry))
query("soc", f"sample_id {KEY} *SOC", "c_soc")(lambda p: health.with_soc(p.telemetry, p.cycles))

oracle.PARTS["c_profile"] = " UNION ALL ".join(
    f"SELECT cell_id, '{n}' AS column_name, "
    f'avg(CASE WHEN "{n}" IS NULL THEN 1e0 ELSE 0e0 END) AS missing_share, '
    f'count(DISTINCT "{n}") + max(CAST("{n}" IS NULL AS INTEGER)) <= 1 AS is_constant, '
    f"{'true' if n in fixed.REQUIRED_RAW else 'false'} AS is_required "
    f"FROM c_tele GROUP BY cell_id"
    for n in ["sample_id", "cycleNumber", "Ns", "time_s", "Ecell_V", "I_mA", "Temperature__C",
              "QDischarge_mA_h", "QCharge_mA_h"])
query("column_profile", "cell_id column_name *missing_share is_constant is_required is_dropped",
      "(SELECT *, NOT is_required AND (is_constant OR missing_share > 0.5e0) AS is_dropped "
      "FROM c_profile)")(lambda p: cy.column_profile(p.telemetry))

# ---------------------------------------------------------------- cycles

query("cycle_summary", f"{KEY} n_rows duration_s *max_voltage *min_voltage *mean_voltage "
      "*max_temp *mean_temp *max_current ~mean_current ~std_current *max_power *mean_power "
      "*QDischarge_mAh *QCharge_mAh energy_discharge energy_charge Ns_mode", "c_facts")(
    lambda p: cy.cycle_summary(cy.cycle_facts(p.telemetry)))
query("discharge_sign", "cell_id rising_rows discharge_sign", "c_sign")(
    lambda p: cy.discharge_sign(p.placed, p.telemetry))
query("capacity_features", f"{KEY} *frac_flight dis_dur_s quasi_cc *QDischarge_mAh *min_voltage "
      "*vdrop", "c_cap")(lambda p: p.capacity_features())


@query("capacity_tests", f"{KEY} n_rows is_capacity_test score dis_dur_s *frac_flight",
       "c_tested")
def capacity_tests(p):
    return cy.attach_capacity_flags(cy.cycle_summary(p.facts), p.tested)


query("capacity_candidates", f"{KEY} candidate_rank score dis_dur_s *frac_flight *QDischarge_mAh",
      "(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY score "
      "DESC, cycleNumber) AS INTEGER) AS candidate_rank FROM c_tested) WHERE candidate_rank <= 3)"
      )(lambda p: cy.capacity_candidates(p.tested))
query("anomalies", f"{KEY} *max_jump_V anomaly_score any_anomaly", "c_cycles")(
    lambda p: cy.with_anomalies(p.facts))
query("mission_cycles", f"{KEY} is_mission +mission_id", "c_cycles")(
    lambda p: cy.with_cycle_position(p.facts))
query("soh", f"{KEY} *initial_capacity_mAh *SOH_pct", "c_soh")(
    lambda p: health.with_soh(p.tested))
query("soh_smoothed", f"{KEY} *SOH_pct *SOH_pct_smoothed", "c_cycles")(
    lambda p: health.with_smoothed_soh(health.with_soh(p.tested)))
query("rul_cycles", f"{KEY} RUL_cycles RUL_censored", "c_cycles")(
    lambda p: health.with_cycle_rul(p.healthy, p.ends))
query("capacity_fade", f"{KEY} is_capacity_test *capacity_mAh *SOH_pct below_eol",
      "(SELECT cell_id, cycleNumber, is_capacity_test, CASE WHEN is_capacity_test THEN "
      "QDischarge_mAh END AS capacity_mAh, SOH_pct_smoothed AS SOH_pct, "
      "SOH_pct_smoothed < 85e0 AS below_eol FROM c_cycles)")(
    lambda p: exploration.capacity_fade(p.cycles))

# ---------------------------------------------------------------- segments

query("segment_energy", f"{SEG} *energy_Wh",
      "(SELECT cell_id, cycleNumber, seg_id, sum(power_W * dt / 3600e0) AS energy_Wh FROM c_seg "
      "GROUP BY cell_id, cycleNumber, seg_id)")(lambda p: segments.segment_energy(p.telemetry))
query("phase_instances", f"{SEG} Ns phase_name phase_family cell_condition t_start_s t_end_s "
      "duration_s *energy_Wh *mean_power_W *max_power_W *mean_abs_power_W ~mean_I_mA *max_I_mA "
      "*min_I_mA *mean_temp_C *max_temp_C *start_SOC *end_SOC *SOH_cycle_pct *cap_Ah "
      "*mean_C_rate *max_C_rate *delta_SOC *start_SOH_pct *end_SOH_pct delta_SOH_pct +mission_id "
      "+phase_order_in_mission is_mission_cycle is_charge_phase is_flight_phase is_rest_phase "
      "is_transition RUL_missions_after_phase RUL_missions_censored *SOH_mission_end_pct",
      "c_phases")(lambda p: segments.phase_instances(
          health.with_soc(p.telemetry, p.cycles), p.cycles))
query("phase_soh", f"{SEG} *SOH_cycle_pct *cap_Ah", "c_phases")(
    lambda p: segments.with_c_rate(segments.segment_totals(p.telemetry).join(
        p.cycles.select(*cy.CYCLE, F.col("SOH_pct_smoothed").alias("SOH_cycle_pct"),
                        "initial_capacity_mAh"), cy.CYCLE, "left")))
query("c_rate", f"{SEG} *cap_Ah *mean_C_rate *max_C_rate", "c_phases")(
    lambda p: segments.with_c_rate(segments.segment_totals(p.telemetry).join(
        p.cycles.select(*cy.CYCLE, F.col("SOH_pct_smoothed").alias("SOH_cycle_pct"),
                        "initial_capacity_mAh"), cy.CYCLE, "left")))
query("phase_family", f"{SEG} phase_name family", "(SELECT cell_id, cycleNumber, seg_id, "
      "phase_name, phase_family AS family FROM c_phases)")(
    lambda p: p.phases.withColumn("family", C.phase_family(F.col("phase_name"))))
query("cell_condition", "cell_id cell_condition n_segments",
      "(SELECT cell_id, cell_condition, count(*) AS n_segments FROM c_phases "
      "GROUP BY cell_id, cell_condition)")(
    lambda p: p.phases.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_segments")).withColumn(
        "cell_condition", C.cell_condition(F.col("cell_id"))))
query("phase_order", f"{SEG} +mission_id +phase_order_in_mission", "c_phases")(
    lambda p: segments.with_phase_order(p.phases.drop("phase_order_in_mission")))
query("rul_phase", f"{SEG} +mission_id RUL_missions_after_phase RUL_missions_censored",
      "c_phases")(lambda p: segments.with_phase_rul(
          p.phases.drop("RUL_missions_after_phase", "RUL_missions_censored").join(
              p.ends, "cell_id")))
query("segment_range_join", f"{SEG} n_samples *sum_V",
      "(SELECT p.cell_id, p.cycleNumber, p.seg_id, count(*) AS n_samples, sum(t.Ecell_V) AS sum_V "
      "FROM c_phases p JOIN c_tele t ON t.cell_id = p.cell_id AND t.cycleNumber = p.cycleNumber "
      "AND t.time_s >= p.t_start_s AND t.time_s <= p.t_end_s "
      "GROUP BY p.cell_id, p.cycleNumber, p.seg_id)")(
    lambda p: segments.segment_range_join(p.phases, p.telemetry).groupBy(*segments.SEGMENT).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("Ecell_V").alias("sum_V")))
query("thermal_features", f"{SEG} *thermal_slope_K_per_s *thermal_gain_K_per_W", "c_phases")(
    lambda p: physics.with_thermal(p.phases))
query("ic_histogram", f"{SEG} bin *vmin *vmax *charge_mAh", "c_ichist")(
    lambda p: physics.ic_histogram(p.segmented()))
query("ic_features", f"{SEG} *ic_centroid_V *ic_spread_V *ic_peak1_V ~ic_peak1_height "
      "*ic_peak2_V ~ic_peak2_height", "c_ic")(
    lambda p: physics.ic_features(physics.ic_histogram(p.segmented())))
query("vi_resistance", f"{SEG} *vi_slope_R_ohm", "c_vi")(
    lambda p: physics.vi_resistance(p.segmented()))
query("phase_features", f"{SEG} phase_name duration_s *thermal_slope_K_per_s "
      "*thermal_gain_K_per_W *ic_centroid_V *ic_peak1_V *vi_slope_R_ohm", "c_pf")(
    lambda p: physics.phase_features(p.phases, p.segmented()))
query("cv_setpoint", "cell_id *v95 *cv_setpoint_V", "c_setpoint")(
    lambda p: physics.cv_setpoint(p.telemetry))

# ---------------------------------------------------------------- missions

query("mission_features", f"{MIS} n_segments dur_flight_s dur_charge_s dur_rest_s "
      "dur_transition_s *energy_flight_Wh *energy_charge_Wh *th_gain_med *th_gain_max *R_ohm_med "
      "*R_ohm_p90 *ic_centroid_V *ic_spread_V *ic_p1_V ~ic_p1_h *SOH_end_pct cc_duration_s "
      "cv_duration_s *cv_energy_Wh *flight_Wh_abs *eff_energy *cv_fraction *cc_fraction "
      "*cv_mean_I_A_proxy *SOH_next_pct *dSOH_drop_pct is_last_mission", "c_ms")(
    lambda p: missions.mission_features(p.phase_features))

DICT_PHASE = [f for f in fixed.PHASE_FEATURES if not f.endswith("_p1_h")]
FLAGS = ["chg_is_charge_phase", "chg_is_CC", "chg_is_CV", "dis_is_flight_phase"]
query("dictionary_phase", f"{SEG} +mission_id " + " ".join(
    f if f in FLAGS else f"*{f}" for f in DICT_PHASE) + " ~chg_ic_p1_h ~dis_ic_p1_h", "c_dp")(
    lambda p: missions.dictionary_phase(p.phase_features))
query("dictionary_mission", f"{MIS} " + " ".join(f"*{f}" for f in fixed.MISSION_FEATURES),
      "c_dm")(lambda p: missions.dictionary_mission(p.dictionary_phase, p.setpoints))

# ---------------------------------------------------------------- exploration

query("phase_stress", "phase_name n median_dur_s *median_energy_Wh *mean_mean_C *mean_max_T",
      "c_stress")(lambda p: exploration.phase_stress(p.phases))
query("mission_table", f"{MIS} n_segments *energy_flight_Wh *energy_charge_Wh *energy_rest_Wh "
      "*energy_transition_Wh dur_takeoff_s dur_cruise_s dur_landing_s dur_cc_s dur_cv_s "
      "dur_rest1_s dur_rest2_s *mean_temp_C *max_temp_C *mean_C_rate *max_C_rate *SOH_end_pct "
      "*SOH_next_pct *dSOH_drop_pct *flight_Wh_abs", "c_mt")(
    lambda p: exploration.mission_table(p.phases))
query("dsoh_spearman", "feature *spearman_r n", "c_spear")(
    lambda p: exploration.dsoh_spearman(p.mission_table))
query("phase_degradation", f"{SEG} +mission_id phase_name phase_family duration_s *energy_Wh "
      "*delta_SOC *mean_abs_power_W *mean_temp_C *max_temp_C *mean_C_rate *max_C_rate "
      "*thermal_slope_K_per_s *thermal_gain_K_per_W", "c_phases")(
    lambda p: exploration.phase_degradation(p.phases))
query("charge_acceptance", f"{MIS} cc_duration_s *cc_energy_Wh *cc_mean_C cv_duration_s "
      "*cv_energy_Wh *cv_mean_C *cv_fraction *cc_fraction *cv_mean_I_A_proxy", "c_accept")(
    lambda p: exploration.charge_acceptance(p.phases))
query("family_energy", f"{MIS} *energy_flight_Wh *energy_charge_Wh *energy_rest_Wh "
      "*energy_transition_Wh dur_flight_s dur_charge_s dur_rest_s dur_transition_s *eff_energy",
      "c_fam")(lambda p: exploration.family_energy(p.phases))
query("mission_degradation", f"{MIS} cc_duration_s cv_duration_s *cv_fraction "
      "*cv_mean_I_A_proxy *energy_flight_Wh *energy_charge_Wh *eff_energy *SOH_mission_end_pct "
      "RUL_missions_after_phase RUL_missions_censored", "c_deg")(
    lambda p: exploration.mission_degradation(p.phases))
query("phase_box_stats", "phase_name feature n *q1 *median *q3 *whisker_low *whisker_high",
      "c_box")(lambda p: exploration.phase_box_stats(exploration.phase_degradation(p.phases)))
query("mission_histograms", "feature bin *bin_low *bin_high n", "c_hist")(
    lambda p: exploration.mission_histograms(p.mission_degradation))
query("phase_trends", "cell_id phase_name mission_id *med_gain *med_dsoc n", "c_trend")(
    lambda p: exploration.phase_trends(exploration.phase_degradation(p.phases)))
query("first_phases", "phase_name",
      "(SELECT phase_name FROM (SELECT phase_name, min((cell_id, cycleNumber, seg_id)) AS f "
      "FROM c_phases GROUP BY phase_name) ORDER BY f LIMIT 12)")(
    lambda p: exploration.first_phases(exploration.phase_degradation(p.phases)))

# ---------------------------------------------------------------- modelling tables and names

PHASE_NAMES = [n for n in fixed.PHASES.values()]
FAMILY_NAMES = sorted(set(fixed.FAMILIES.values()))
oracle.PARTS["c_onehot"] = (
    f"SELECT cell_id, cycleNumber, seg_id, {oracle.one_hot('phase_name', PHASE_NAMES)}, "
    f"{oracle.one_hot('phase_family', FAMILY_NAMES)} FROM c_phases")
oracle.PARTS["c_onehotlong"] = oracle.unpivot(
    "c_onehot", "cell_id, cycleNumber, seg_id",
    [f"phase_name_{n}" for n in PHASE_NAMES] + [f"phase_family_{n}" for n in FAMILY_NAMES])


@query("one_hot_phase", f"{SEG} feature x", "(SELECT cell_id, cycleNumber, seg_id, feature, "
       "CAST(x AS INTEGER) AS x FROM c_onehotlong)")
def one_hot_phase(p):
    """One-hot columns of phase and family, shown as rows because their names hold symbols."""
    wide = tables.one_hot(p.phases.select(*segments.SEGMENT, "phase_name", "phase_family"),
                          ["phase_name", "phase_family"])
    flags = [c for c in wide.columns if c not in segments.SEGMENT]
    return wide.select(*segments.SEGMENT, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), tables.quoted(c).alias("x")) for c in flags])
    ).alias("_p")).select(*segments.SEGMENT, "_p.*")


def _value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    counts = df.agg(*[F.count(tables.quoted(n)).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("feature"), tables.quoted(n).alias("n_values")) for n in names])
    ).alias("_p")).select("_p.*")


def _value_counts_sql(source: str, names: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count(\"{n}\") AS n_values{extra} FROM {source}"
        for n in names)


oracle.PARTS["c_space"] = (
    _value_counts_sql("c_dp", oracle.PHASE_MODEL, ", 'phase' AS level") + " UNION ALL "
    + _value_counts_sql("c_dm", oracle.MISSION_MODEL, ", 'mission' AS level"))


@query("feature_space", "level feature n_values", "c_space")
def feature_space(p):
    """Dictionary features per level that are present and no key or label, with value counts."""
    parts = []
    for level, df in (("phase", p.dictionary_phase), ("mission", p.dictionary_mission)):
        chosen = tables.feature_names(p.spark, level, df.columns).select("feature")
        listed = [c for c in df.columns if c in tables.model_features(level, df.columns)]
        parts.append(_value_counts(df, listed).join(chosen, "feature").withColumn(
            "level", F.lit(level)))
    return parts[0].unionByName(parts[1])


MISSION_COLUMNS = ["cell_id", "mission_id", "SOH_end_pct", "SOH_next_pct", "dSOH_drop_pct",
                   "n_segments", "is_last_mission", *fixed.SOH_TABLE]
_LEAK_SQL = " OR ".join(f"regexp_matches(lower(feature), '{p}')" for p in fixed.LEAK_PATTERNS)
oracle.PARTS["c_names"] = _value_counts_sql("c_ms", MISSION_COLUMNS)
query("leakage_name_guard", "feature n_values kept",
      f"(SELECT *, NOT ({_LEAK_SQL}) AS kept FROM c_names)")(
    lambda p: tables.leakage_name_guard(_value_counts(p.missions, MISSION_COLUMNS)))

query("soc_table", f"{SEG} duration_s *energy_Wh *mean_abs_power_W *mean_temp_C *max_temp_C "
      "*mean_C_rate *max_C_rate *thermal_slope_K_per_s *thermal_gain_K_per_W *vi_slope_R_ohm "
      "*ic_centroid_V *ic_spread_V *ic_peak1_V ~ic_peak1_height phase_name_Cruise "
      "phase_family_flight *target",
      "(SELECT *, CASE WHEN phase_name = 'Cruise' THEN 1 ELSE 0 END AS phase_name_Cruise, "
      "CASE WHEN phase_family = 'flight' THEN 1 ELSE 0 END AS phase_family_flight, "
      "delta_SOC AS target FROM c_pf WHERE mission_id IS NOT NULL AND delta_SOC IS NOT NULL AND "
      + " AND ".join(f"{c} IS NOT NULL" for c in fixed.SOC_TABLE) + ")")(
    lambda p: tables.soc_table(p.phase_features))
query("soh_table", f"{MIS} " + " ".join(
    ("~" if f == "ic_p1_h" else "*") + f for f in fixed.SOH_TABLE) + " *target",
    "(SELECT *, SOH_next_pct AS target FROM c_ms WHERE NOT is_last_mission AND "
    "SOH_next_pct IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in fixed.SOH_TABLE)
    + ")")(lambda p: tables.soh_table(p.missions))
oracle.PARTS["c_rultab"] = (
    "SELECT cell_id, mission_id, max(RUL_missions_after_phase) AS target, "
    "quantile_cont(thermal_gain_K_per_W, 0.5) AS thermal_gain_med, "
    "quantile_cont(mean_C_rate, 0.5) AS mean_C, quantile_cont(max_C_rate, 0.5) AS max_C, "
    "quantile_cont(max_temp_C, 0.5) AS max_T, quantile_cont(vi_slope_R_ohm, 0.5) AS vi_R, "
    "quantile_cont(ic_centroid_V, 0.5) AS ic_centroid_V, "
    f"{oracle.fam_sum('energy_Wh', 'flight')} AS flight_Wh, "
    f"{oracle.fam_sum('energy_Wh', 'charge')} AS charge_Wh "
    "FROM c_pf WHERE mission_id IS NOT NULL GROUP BY cell_id, mission_id")
query("rul_table", f"{MIS} " + " ".join(f"*{f}" for f in fixed.RUL_TABLE) + " target",
      "(SELECT * FROM c_rultab WHERE target IS NOT NULL AND "
      + " AND ".join(f"{c} IS NOT NULL" for c in fixed.RUL_TABLE) + ")")(
    lambda p: tables.rul_table(p.phase_features))

# ---------------------------------------------------------------- sequences

SEQ = "length *label ~steps_sum ~first_step_sum ~last_step_sum"


def _flattened(sequences_df: DataFrame) -> DataFrame:
    """Sums over a sequence: of all steps, of its first and of its last step."""
    def total(step):
        return F.aggregate(step, F.lit(0.0), lambda a, x: a + x)

    return sequences_df.withColumns({
        "steps_sum": F.aggregate("steps", F.lit(0.0), lambda a, s: a + total(s)),
        "first_step_sum": total(F.col("steps")[0]),
        "last_step_sum": total(F.element_at("steps", -1))})


def _soc_sequences(p: Pipeline) -> DataFrame:
    rows, features = sequences.soc_rows(p.dictionary_phase)
    return sequences.soc_sequences(rows, features)


def _horizon(p: Pipeline) -> tuple[DataFrame, list[str]]:
    rows, features = sequences.mission_rows(p.dictionary_mission)
    return sequences.soh_horizon(rows), features


def _rul_rows(p: Pipeline) -> tuple[DataFrame, list[str]]:
    rows, features = sequences.mission_rows(p.dictionary_mission)
    return sequences.rul_missions(rows), features


query("soc_sequences", f"{MIS} seg_id {SEQ}", "c_socseq")(
    lambda p: _flattened(_soc_sequences(p)))


@query("soh_sequences", f"{MIS} {SEQ}", "c_sohseq")
def soh_sequences(p):
    rows, features = _horizon(p)
    return _flattened(sequences.mission_sequences(rows, features, "dSOH_to_future"))


@query("rul_sequences", f"{MIS} eol {SEQ}", "c_rulseq")
def rul_sequences(p):
    rows, features = _rul_rows(p)
    return _flattened(sequences.mission_sequences(rows, features, "RUL_missions", keys=["eol"]))


query("soh_horizon", f"{MIS} *SOH_end_pct *SOH_future *dSOH_to_future", "c_horizon")(
    lambda p: _horizon(p)[0])
query("rul_missions", f"{MIS} eol RUL_missions RUL_censored", "c_rul")(lambda p: _rul_rows(p)[0])

PLAIN_MISSION = " ".join(f"*{f}" for f in oracle.MISSION_MODEL)


@query("last_step", f"{MIS} {PLAIN_MISSION}", "c_mrow")
def last_step(p):
    rows, features = sequences.mission_rows(p.dictionary_mission)
    return sequences.last_rows(rows, features, "SOH_end_pct")


@query("padded_sequences", f"{MIS} seg_id length padded_length n_real n_zero_steps ~steps_sum",
       "(SELECT cell_id, mission_id, seg_id, length, 16 AS padded_length, length AS n_real, "
       "16 - length AS n_zero_steps, steps_sum FROM c_socseq)")
def padded_sequences(p):
    out = sequences.padded(_soc_sequences(p), fixed.SOC_STEPS)
    zero = F.filter("padded", lambda s: F.forall(s, lambda x: x == 0.0))
    return out.withColumns({
        "padded_length": F.size("padded"),
        "n_real": F.size(F.filter("mask", lambda m: m)), "n_zero_steps": F.size(zero),
        "steps_sum": F.aggregate(F.flatten("padded"), F.lit(0.0), lambda a, x: a + x)})


@query("sequence_scaler", "feature n_steps ~mean ~std", "c_scaler")
def sequence_scaler(p):
    rows, features = sequences.mission_rows(p.dictionary_mission)
    return sequences.window_scaler(rows, features, ["cell_id"], "mission_pos",
                                   fixed.MISSION_STEPS)


@query("sequence_pooled", f"{MIS} feature ~last ~mean ~min ~max ~slope", "c_pool")
def sequence_pooled(p):
    return sequences.pooled_long(*sequences.mission_rows(p.dictionary_mission))

# ---------------------------------------------------------------- folds


query("loco_folds", "hold n_test n_train is_run",
      "(SELECT cell_id AS hold, n AS n_test, CAST(sum(n) OVER () - n AS BIGINT) AS n_train, "
      "n > 0 AND sum(n) OVER () - n >= 50 AS is_run FROM c_size)")(
    lambda p: folds.loco_folds(_horizon(p)[0]))
query("group_kfold", "hold cell_id n +fold role", "c_role")(
    lambda p: folds.fold_roles(_horizon(p)[0]))


@query("leakage_corr_guard", "hold feature pairs *corr kept",
       "(SELECT *, pairs < 10 OR corr IS NULL OR abs(corr) < 0.995e0 AS kept FROM c_corr)")
def leakage_corr_guard(p):
    rows = p.horizon
    features = tables.safe_names(oracle.MISSION_MODEL)
    stats = folds.cell_statistics(rows, features, "dSOH_to_future")
    return folds.corr_guard(folds.fold_statistics(stats, p.roles))


@query("fold_scaling", "hold feature n n_null ~fill ~center ~scale", "c_scale")
def fold_scaling(p):
    """Median fill and scaling on mission features that still have missing values."""
    rows = p.missions.where(~F.col("is_last_mission"))
    roles = p.roles
    features = fixed.SOH_TABLE
    stats = folds.fold_statistics(folds.cell_statistics(rows, features, "dSOH_drop_pct"), roles)
    return folds.fold_scaling(stats, folds.fold_medians(rows, features, "dSOH_drop_pct", roles))


query("fold_prepare", "hold feature pairs *corr kept ~fill ~center ~scale", "c_prep")(
    lambda p: folds.fold_prepare(p.horizon, tables.safe_names(oracle.MISSION_MODEL),
                                 "dSOH_to_future", roles=p.roles))

# ---------------------------------------------------------------- predictions


def _predictions(p: Pipeline, shift: int = 0) -> DataFrame:
    """Remaining-life labels with a deterministic error, one row per mission and level."""
    error = (F.col("mission_id") * 37 + F.col("eol") * 7 + shift) % 11 - 5
    return predictions.prediction_table(_rul_rows(p)[0].select(
        "eol", "cell_id", "mission_id", F.col("RUL_missions").alias("y_true"),
        (F.col("RUL_missions") + error).alias("y_pred")))


def _soh_predictions(p: Pipeline) -> DataFrame:
    error = ((F.col("mission_id") * 13) % 7 - 3) / F.lit(10.0)
    return _horizon(p)[0].select(
        "cell_id", "mission_id", F.col("dSOH_to_future").alias("y_true"),
        (F.col("dSOH_to_future") + error).alias("y_pred"))


query("predictions", f"{MIS} eol y_true y_pred", "c_pred")(_predictions)
query("soh_reconstruct", f"{MIS} *SOH_now *y_true *y_pred *y_true_pp *y_pred_pp",
      "(SELECT *, least(greatest(SOH_now - y_true, 0e0), 100e0) AS y_true_pp, "
      "least(greatest(SOH_now - y_pred, 0e0), 100e0) AS y_pred_pp FROM c_sohpred)")(
    lambda p: predictions.soh_reconstruct(_soh_predictions(p), p.missions))
query("per_cell_metrics", "eol cell_id *MAE *RMSE N", "c_cellmet")(
    lambda p: predictions.per_cell_metrics(_predictions(p), ["eol"]))
query("fleet_metrics", "eol num_cells total_samples *MAE_mean *MAE_median *RMSE_mean "
      "*RMSE_median",
      "(SELECT eol, count(DISTINCT cell_id) AS num_cells, CAST(sum(N) AS BIGINT) AS "
      "total_samples, avg(MAE) AS MAE_mean, quantile_cont(MAE, 0.5) AS MAE_median, "
      "avg(RMSE) AS RMSE_mean, quantile_cont(RMSE, 0.5) AS RMSE_median FROM c_cellmet "
      "GROUP BY eol)")(
    lambda p: predictions.fleet_metrics(predictions.per_cell_metrics(_predictions(p), ["eol"]),
                                        ["eol"]))

COMPARED = fixed.MODEL_ORDER[:4]


@query("model_comparison", "task model model_rank *MAE_mean *RMSE_mean N_cells N_total",
       "(SELECT task, model, model_rank, avg(MAE) AS MAE_mean, avg(RMSE) AS RMSE_mean, "
       "count(DISTINCT cell_id) AS N_cells, CAST(sum(N) AS BIGINT) AS N_total FROM ("
       + " UNION ALL ".join(
           f"SELECT 'rul_mission_' || eol AS task, '{m}' AS model, {i} AS model_rank, cell_id, "
           f"avg(abs(e)) AS MAE, sqrt(avg(e * e)) AS RMSE, count(*) AS N FROM (SELECT eol, "
           f"cell_id, ((mission_id * 37 + eol * 7 + {3 * i}) % 11) - 5e0 AS e FROM c_pred) "
           "GROUP BY eol, cell_id" for i, m in enumerate(COMPARED))
       + ") GROUP BY task, model, model_rank)")
def model_comparison(p):
    base = _rul_rows(p)[0]
    shifted = base.withColumn("_m", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(3 * i).alias("shift"))
        for i, m in enumerate(COMPARED)])))
    error = (F.col("mission_id") * 37 + F.col("eol") * 7 + F.col("_m.shift")) % 11 - 5
    table = shifted.select(
        "cell_id", "mission_id", F.col("_m.model").alias("model"),
        F.concat(F.lit("rul_mission_"), F.col("eol")).alias("task"),
        F.col("RUL_missions").alias("y_true"), (F.col("RUL_missions") + error).alias("y_pred"))
    return predictions.model_comparison(predictions.per_cell_metrics(table, ["task", "model"]))


query("rul_monotonicity", "*viol_85_gt_80 *viol_90_gt_85 *viol_any N",
      "(SELECT avg(CASE WHEN p85 > p80 THEN 1e0 ELSE 0e0 END) AS viol_85_gt_80, "
      "avg(CASE WHEN p90 > p85 THEN 1e0 ELSE 0e0 END) AS viol_90_gt_85, "
      "avg(CASE WHEN p85 > p80 OR p90 > p85 THEN 1e0 ELSE 0e0 END) AS viol_any, count(*) AS N "
      "FROM c_wide)")(
    lambda p: predictions.rul_monotonicity(predictions.across_levels(_predictions(p))))


@query("isotonic_rul", f"{MIS} eol y_true y_pred *y_pred_cal", "c_isolong")
def isotonic_rul(p):
    guesses = _predictions(p)
    fitted = predictions.with_isotonic(predictions.across_levels(guesses))
    return predictions.attach_calibrated(guesses, fitted)


query("isotonic_summary", "*viol_before *viol_after N",
      "(SELECT avg(CASE WHEN p85 > p80 OR p90 > p85 THEN 1e0 ELSE 0e0 END) AS viol_before, "
      "avg(CASE WHEN f85 > f80 OR f90 > f85 THEN 1e0 ELSE 0e0 END) AS viol_after, "
      "count(*) AS N FROM c_iso)")(
    lambda p: predictions.isotonic_summary(predictions.with_isotonic(
        predictions.across_levels(_predictions(p)))))
query("cascade_rul", f"{MIS} cas80 cas85 cas90",
      "(SELECT cell_id, mission_id, p80 AS cas80, least(p80, p85) AS cas85, "
      "least(p80, p85, p90) AS cas90 FROM c_wide)")(
    lambda p: predictions.with_cascade(predictions.across_levels(_predictions(p))))
query("rul_increase_audit", "eol *mean_increase n_cells",
      "(SELECT eol, avg(m) AS mean_increase, count(*) AS n_cells FROM (SELECT eol, cell_id, "
      "avg(rise) AS m FROM (SELECT eol, cell_id, greatest(y_pred - lag(y_pred) OVER (PARTITION "
      "BY eol, cell_id ORDER BY mission_id), 0e0) AS rise, row_number() OVER (PARTITION BY eol, "
      "cell_id ORDER BY mission_id) AS k FROM c_pred) WHERE k > 1 GROUP BY eol, cell_id) "
      "GROUP BY eol)")(lambda p: predictions.rul_increase_audit(_predictions(p)))

# ---------------------------------------------------------------- arrays

query("attention_summary", "vec_id length attn_argmax *attn_max *attn_entropy",
      "(SELECT vec_id, CAST(count(*) AS INTEGER) AS length, CAST(arg_max(pos, p) AS INTEGER) AS "
      "attn_argmax, max(p) AS attn_max, -sum((p / s) * ln(p / s + 1e-12)) / ln(count(*)) AS "
      "attn_entropy FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id) + 1e-12 AS s FROM c_att) "
      "GROUP BY vec_id)")(lambda p: predictions.attention_summary(p.arrays))
@query("ragged_arrays", "vec_id length *first_value *last_value ~total",
       "(SELECT vec_id, CAST(len(r) AS INTEGER) AS length, r[1] AS first_value, "
       "r[-1] AS last_value, coalesce(list_sum(r), CASE WHEN r IS NOT NULL THEN 0e0 END) AS total "
       "FROM (SELECT vec_id, CASE WHEN vec_id % 17 <> 16 THEN g[1:vec_id % (len(g) + 1)] END AS r "
       "FROM c_arr))")
def ragged_arrays(p):
    """Arrays of differing lengths, some empty or NULL, through the ragged store and back."""
    g = F.col("gate_logits")
    cut = F.slice(g, F.lit(1), F.pmod(F.col("vec_id"), F.size(g) + 1).cast("int"))
    rows = p.arrays.select("vec_id", F.when(F.col("vec_id") % 17 != 16, cut).alias("r"))
    path = p.store.path(f"ragged-{uuid.uuid4().hex}")
    ragged.write_ragged(rows, ["vec_id"], "r", path)
    r = F.col("r")
    return ragged.read_ragged(p.spark, path).select(
        "vec_id", F.when(r.isNotNull(), F.size(r)).alias("length"),
        F.get(r, F.lit(0)).alias("first_value"), F.try_element_at(r, F.lit(-1)).alias("last_value"),
        F.aggregate(r, F.lit(0.0), lambda a, x: a + x).alias("total"))


query("gate_top2", "vec_id gate_top1 *gate_pi_top1 gate_top2 *gate_pi_top2",
      "(SELECT vec_id, CAST(max(pos) FILTER (WHERE k = 1) AS INTEGER) AS gate_top1, "
      "max(p) FILTER (WHERE k = 1) AS gate_pi_top1, CAST(max(pos) FILTER (WHERE k = 2) AS "
      "INTEGER) AS gate_top2, max(p) FILTER (WHERE k = 2) AS gate_pi_top2 FROM (SELECT *, "
      "row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS k FROM c_gate) "
      "GROUP BY vec_id)")(lambda p: predictions.gate_top2(p.arrays))
query("gate_entropy", "*gate_entropy n",
      "(SELECT avg(e) AS gate_entropy, count(*) AS n FROM (SELECT vec_id, "
      "-sum(pe * ln(pe)) / ln(count(*)) AS e FROM c_gate GROUP BY vec_id))")(
    lambda p: predictions.gate_entropy(p.arrays))

# ---------------------------------------------------------------- models (rows only)
# Forests and boosted trees run with the operators' defaults, see ``models.SCALE``.


def _as_rows(name: str, columns: str):
    return query(name, columns, None)


def _importance(p: Pipeline, measure) -> DataFrame:
    """One measure over the three modelling tables."""
    parts = [measure(tables.soc_table(p.phase_features), segments.SEGMENT, "SOC_phase_delta"),
             measure(p.soh_model_table, missions.MISSION, "SOH_next_mission"),
             measure(tables.rul_table(p.phase_features), missions.MISSION, "RUL_missions")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_as_rows("feature_importance", "task feature gini_importance r2")
def feature_importance(p):
    return _importance(p, models.feature_importance)


@_as_rows("permutation_importance", "task feature perm_importance_mean perm_importance_std")
def permutation_importance(p):
    return _importance(p, models.permutation_importance)


def _loco_features(level: str, rows: DataFrame) -> list[str]:
    """Dictionary features of a level and the one-hot test conditions."""
    return tables.model_features(level, rows.columns) + _conditions(rows)


def _conditions(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith(("cell_condition_", "test_condition_"))]


SEGMENTS = ["cell_id", "mission_id", "cycleNumber", "seg_id"]


def _tasks(p: Pipeline, pooled: bool = False):
    """``(task, rows, features, label, keys)`` of the five tasks: SOC, SOH and RUL at 80 / 85 / 90."""
    soc, soh, rul = ((p.pooled_soc, p.pooled_horizon, p.pooled_rul) if pooled else
                     (p.soc_samples, p.horizon, p.rul_samples))

    def features(level: str, rows: DataFrame) -> list[str]:
        if not pooled:
            return _loco_features(level, rows)
        inputs = [c for c in rows.columns if not c.endswith(POOLED)]
        return [f"{f}__{k}" for f in tables.model_features(level, inputs)
                for k in sequences.POOLS] + _conditions(rows)

    yield "soc_phase_delta", soc, features("phase", soc), "label", SEGMENTS
    yield "soh_next", soh, features("mission", soh), "dSOH_to_future", missions.MISSION
    for level in fixed.EOL_SWEEP:
        rows = rul.where(F.col("eol") == level)
        yield f"rul_eol_{level}", rows, features("mission", rul), "RUL_missions", missions.MISSION


POOLED = tuple(f"__{k}" for k in sequences.POOLS)
PRED = "task cell_id mission_id cycleNumber seg_id y_true y_pred model"


#: Groups of models that are grown together.
GROUPS = {"rf": [models.FOREST], "gbt": list(models.PRESETS.values()),
          "seq": [replace(models.FOREST, name="pooled_rf")]}


def _held_out(p: Pipeline, group: str, only: Sequence[str] | None = None) -> DataFrame:
    """Held-out predictions of a group of models over the five tasks (or ``only`` some); segments
    are NULL for missions. Fitted once per pipeline, read from the log afterwards."""
    pooled = group == "seq"

    def one(task: str, rows: DataFrame, features: list[str], label: str, keys: list[str]):
        return models.logged_predictions(
            p.log(task, group), rows, features, label, keys, GROUPS[group],
            roles=p.roles if task == "soh_next" else None,
            min_train=fixed.MIN_TRAIN_ROWS if pooled else 1).withColumn("task", F.lit(task))

    tasks = [t for t in _tasks(p, pooled) if only is None or t[0] in only]
    with ThreadPool(len(tasks)) as pool:  # the preparing jobs of the tasks share the cluster
        parts = pool.starmap(one, tasks)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for key in SEGMENTS:
        if key not in out.columns:
            out = out.withColumn(key, F.lit(None).cast("int"))
    return out


def _all_models(p: Pipeline, only: Sequence[str] | None = None) -> DataFrame:
    return _held_out(p, "rf", only).unionByName(_held_out(p, "gbt", only)).unionByName(
        _held_out(p, "seq", only))


@_as_rows("loco_rf", PRED)
def loco_rf(p):
    return _held_out(p, "rf")


@_as_rows("loco_gbt", PRED)
def loco_gbt(p):
    return _held_out(p, "gbt")


@_as_rows("loco_seq", PRED)
def loco_seq(p):
    """Forest on pooled trailing windows, the stand-in for the recurrent networks."""
    return _held_out(p, "seq")


@_as_rows("loco_eval", "task model num_cells total_samples MAE_mean MAE_median RMSE_mean "
          "RMSE_median")
def loco_eval(p):
    """Fleet metrics of forest, boosted presets and pooled forest over the five tasks."""
    by = ["task", "model"]
    return predictions.fleet_metrics(predictions.per_cell_metrics(_all_models(p), by), by)


@_as_rows("grid_sweep", "eol depth step MAE_mean RMSE_mean cells N_total")
def grid_sweep(p):
    out = None
    for level in fixed.EOL_SWEEP:
        one = models.grid_sweep(p.rul_samples.where(F.col("eol") == level),
                                _loco_features("mission", p.rul_samples),
                                "RUL_missions", missions.MISSION,
                                {"depth": [2, 4], "step": [0.1, 0.3]}
                                ).withColumn("eol", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- metrics of fitted models

RUL_TASKS = [f"rul_eol_{level}" for level in fixed.EOL_SWEEP]
MISSION_TASKS = ["soh_next", *RUL_TASKS]
_MODELS = "(VALUES ('rf'), ('xgb'), ('catboost'), ('lightgbm')) AS m(model)"


def _fitted_rul(p: Pipeline) -> DataFrame:
    """The forest's held-out remaining life at every level."""
    return _held_out(p, "rf", RUL_TASKS).select(
        F.substring_index("task", "_", -1).cast("int").alias("eol"), "cell_id", "mission_id",
        "y_true", "y_pred")


@query("loco_truth", "task model cell_id mission_id *y_true is_sane",
       "(SELECT task, model, cell_id, mission_id, y_true, TRUE AS is_sane FROM (SELECT 'soh_next' "
       "AS task, cell_id, mission_id, dSOH_to_future AS y_true FROM c_horizon UNION ALL SELECT "
       "'rul_eol_' || eol, cell_id, mission_id, RUL_missions FROM c_rul) CROSS JOIN "
       + _MODELS + ")")
def loco_truth(p):
    """Every mission is predicted once by every model, from its true label on; a forest stays within
    the labels that it has seen, a boosted model is finite."""
    guesses = _held_out(p, "rf", MISSION_TASKS).unionByName(_held_out(p, "gbt", MISSION_TASKS))
    ends = guesses.groupBy("task").agg(F.min("y_true").alias("lo"), F.max("y_true").alias("hi"))
    inside = F.col("y_pred").between(F.col("lo") - 1e-6, F.col("hi") + 1e-6)
    finite = F.col("y_pred").isNotNull() & ~F.isnan("y_pred") & (F.abs("y_pred") < 1e12)
    return ends.join(guesses, "task").withColumn(
        "is_sane", F.when(F.col("model") == "rf", inside).otherwise(finite))


@_as_rows("fitted_per_cell", "task model cell_id MAE RMSE N")
def fitted_per_cell(p):
    return predictions.per_cell_metrics(_all_models(p), ["task", "model"])


@_as_rows("fitted_comparison", "task model model_rank MAE_mean RMSE_mean N_cells N_total")
def fitted_comparison(p):
    return predictions.model_comparison(fitted_per_cell(p))


@_as_rows("fitted_soh", f"{MIS} SOH_now y_true y_pred y_true_pp y_pred_pp")
def fitted_soh(p):
    return predictions.soh_reconstruct(_held_out(p, "rf", ["soh_next"]).select(
        "cell_id", "mission_id", "y_true", "y_pred"), p.missions)


@_as_rows("fitted_monotonicity", "viol_85_gt_80 viol_90_gt_85 viol_any N")
def fitted_monotonicity(p):
    return predictions.rul_monotonicity(predictions.across_levels(_fitted_rul(p)))


@_as_rows("fitted_isotonic", f"{MIS} eol y_true y_pred y_pred_cal")
def fitted_isotonic(p):
    guesses = _fitted_rul(p)
    return predictions.attach_calibrated(guesses, predictions.with_isotonic(
        predictions.across_levels(guesses)))


@_as_rows("fitted_isotonic_summary", "viol_before viol_after N")
def fitted_isotonic_summary(p):
    return predictions.isotonic_summary(predictions.with_isotonic(
        predictions.across_levels(_fitted_rul(p))))


@_as_rows("fitted_cascade", f"{MIS} cas80 cas85 cas90")
def fitted_cascade(p):
    return predictions.with_cascade(predictions.across_levels(_fitted_rul(p)))


@_as_rows("fitted_increase_audit", "eol mean_increase n_cells")
def fitted_increase_audit(p):
    return predictions.rul_increase_audit(_fitted_rul(p))


# ---------------------------------------------------------------- entry points


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].spark(pipeline(spark, folder))
