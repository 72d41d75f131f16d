"""SQL of the named intermediate results that the catalog queries are checked against.

Each entry of ``PARTS`` is one common table expression; :func:`statement` adds the ones a final
SELECT needs. The SQL is written on its own terms (whole-cell windows, row expansion, full bin
grids) rather than following the Spark plans.
"""

from __future__ import annotations

import re

from voltarc.functions import fixed

CELLS_IN_TESTS = [f"VAH{i:02d}" for i in range(1, 9)]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case(values: dict, subject: str, default: str) -> str:
    arms = " ".join(f"WHEN {k if isinstance(k, int) else text(k)} THEN {text(v)}"
                    for k, v in values.items())
    return f"CASE {subject} {arms} ELSE {text(default)} END"


def family(name: str) -> str:
    return case(fixed.FAMILIES, name, "other")


def fam_sum(value: str, fam: str) -> str:
    return (f"coalesce(sum(CASE WHEN phase_family = '{fam}' THEN coalesce({value}, 0e0) "
            "ELSE 0e0 END), 0e0)")


def phase_total(value: str, phase: str) -> str:
    return (f"coalesce(sum(CASE WHEN phase_name = {text(phase)} THEN coalesce({value}, 0e0) "
            "ELSE 0e0 END), 0e0)")


def quoted(name: str) -> str:
    return f'"{name}"'


FAMILIES = ["flight", "charge", "rest", "transition"]
CONDITION_VALUES = sorted({fixed.CONDITIONS.get(c, "unknown") for c in CELLS_IN_TESTS})
CONDITION_COLUMNS = [f"cell_condition_{v}" for v in CONDITION_VALUES]


def one_hot(column: str, values: list[str]) -> str:
    return ", ".join(f"CASE WHEN {column} = {text(v)} THEN 1 ELSE 0 END AS "
                     + quoted(f"{column}_{v}") for v in values)


MISSION_MODEL = [f for f in fixed.MISSION_FEATURES if f not in fixed.META_COLUMNS]
PHASE_MODEL = [f for f in fixed.PHASE_FEATURES if f not in fixed.META_COLUMNS]
MISSION_MODEL_ALL = MISSION_MODEL + CONDITION_COLUMNS
PHASE_MODEL_ALL = PHASE_MODEL + CONDITION_COLUMNS
GUARDED = [f for f in MISSION_MODEL
           if not any(re.search(p, f.lower()) for p in fixed.LEAK_PATTERNS)]


def filled(names: list[str]) -> str:
    return ", ".join(f"coalesce(CAST({quoted(n)} AS DOUBLE), 0e0) AS {quoted(n)}" for n in names)


def unpivot(source: str, keys: str, names: list[str], value: str = "x") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {text(n)} AS feature, CAST({quoted(n)} AS DOUBLE) AS {value} "
        f"FROM {source}" for n in names)


PARTS: dict[str, str] = {}

PARTS["c_raw"] = """
SELECT event_id, value, CAST(user_id % 8 AS INTEGER) AS c,
       row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS rn,
       count(*) OVER (PARTITION BY user_id % 8) AS n
FROM events"""

PARTS["c_raw2"] = """
SELECT *, CAST(rn // 50 AS INTEGER) AS cyc, CAST(rn % 50 AS INTEGER) AS p,
       CAST(n // 50 + 1 AS DOUBLE) AS nc, (rn // 50) % 5 = 0 AS ct
FROM c_raw"""

PARTS["c_tele"] = """
SELECT event_id AS sample_id, 'VAH' || lpad(CAST(c + 1 AS VARCHAR), 2, '0') AS cell_id,
       cyc AS "cycleNumber",
       CAST(CASE WHEN event_id % 1999 = 1998 THEN NULL
            WHEN p < 10 THEN 0 WHEN p < 18 THEN 1 WHEN ct THEN 9 WHEN p < 20 THEN 2
            WHEN p < 22 THEN 3 WHEN p < 27 THEN 4 WHEN p < 39 THEN 5 WHEN p < 44 THEN 6
            WHEN p < 46 THEN 7 WHEN p < 48 THEN 8 ELSE 9 END AS INTEGER) AS "Ns",
       CAST(p * 60 + event_id % 7 AS DOUBLE) AS time_s,
       CASE WHEN p < 18 THEN 3e0 + 0.06e0 * p WHEN ct THEN 4.1e0 - 0.045e0 * (p - 18)
            ELSE 4.1e0 - 0.035e0 * (p - 18) END
         + (event_id % 11) / 200e0
         + CASE WHEN event_id % 997 = 996 THEN 0.8e0 ELSE 0e0 END AS "Ecell_V",
       CASE WHEN c % 2 = 0 THEN 1e0 ELSE -1e0 END
         * CASE WHEN p < 18 THEN -(1000e0 + 2e0 * value) WHEN ct THEN 1000e0 + 0.5e0 * value
                WHEN p BETWEEN 22 AND 43 THEN 3000e0 + 8e0 * value ELSE 5e0 END AS "I_mA",
       20e0 + 0.5e0 * (event_id % 23)
         + CASE WHEN p BETWEEN 22 AND 43 THEN 8e0 ELSE 0e0 END AS "Temperature__C",
       greatest(p - 18, 0) / 31e0 * 3000e0 * (1e0 - 0.3e0 * cyc / nc)
         * CASE WHEN ct THEN 1e0 ELSE 0.6e0 END AS "QDischarge_mA_h",
       least(p, 18) / 18e0 * 2900e0 AS "QCharge_mA_h"
FROM c_raw2"""

PARTS["c_smp"] = """
SELECT *, Ecell_V * I_mA / 1000e0 AS power_W,
       greatest(coalesce(time_s - lag(time_s) OVER w, 0e0), 0e0) AS dt,
       coalesce(time_s - lag(time_s) OVER w, 0e0) / 3600e0 AS dt_h,
       abs(Ecell_V - lag(Ecell_V) OVER w) AS jump,
       row_number() OVER w AS nth, lag(Ns) OVER w AS prev_ns
FROM c_tele
WINDOW w AS (PARTITION BY cell_id, cycleNumber ORDER BY time_s, sample_id)"""

PARTS["c_mode"] = """
SELECT cell_id, cycleNumber, Ns AS ns_top FROM (
  SELECT cell_id, cycleNumber, Ns, row_number() OVER (
    PARTITION BY cell_id, cycleNumber ORDER BY count(*) DESC, Ns) AS k
  FROM c_tele WHERE Ns IS NOT NULL GROUP BY cell_id, cycleNumber, Ns) WHERE k = 1"""

PARTS["c_facts"] = """
SELECT f.*, coalesce(m.ns_top, -1) AS Ns_mode FROM (
  SELECT cell_id, cycleNumber, count(*) AS n_rows, max(time_s) - min(time_s) AS duration_s,
         max(Ecell_V) AS max_voltage, min(Ecell_V) AS min_voltage, avg(Ecell_V) AS mean_voltage,
         max(Temperature__C) AS max_temp, avg(Temperature__C) AS mean_temp,
         max(I_mA) AS max_current, avg(I_mA) AS mean_current, stddev_samp(I_mA) AS std_current,
         max(power_W) AS max_power, avg(power_W) AS mean_power,
         max(QDischarge_mA_h) AS QDischarge_mAh, max(QCharge_mA_h) AS QCharge_mAh,
         CAST(NULL AS DOUBLE) AS energy_discharge, CAST(NULL AS DOUBLE) AS energy_charge,
         avg(CASE WHEN Ns IN (4, 5, 6) THEN 1e0 ELSE 0e0 END) AS frac_flight,
         max(jump) AS max_jump_V,
         coalesce(bool_or(Ns = 4) AND bool_or(Ns = 6), false) AS is_mission
  FROM c_smp GROUP BY cell_id, cycleNumber) f
LEFT JOIN c_mode m ON m.cell_id = f.cell_id AND m.cycleNumber = f.cycleNumber"""

PARTS["c_sign"] = """
SELECT cell_id, rising_rows,
       CASE WHEN (CASE WHEN rising_rows < 10 THEN med ELSE rising_mean END) > 0 THEN 1 ELSE -1 END
         AS discharge_sign
FROM (
  SELECT cell_id, count(*) FILTER (WHERE dq > 0) AS rising_rows,
         avg(I_mA) FILTER (WHERE dq > 0) AS rising_mean, quantile_cont(I_mA, 0.5) AS med
  FROM (SELECT cell_id, I_mA, QDischarge_mA_h - lag(QDischarge_mA_h) OVER (
          PARTITION BY cell_id ORDER BY cycleNumber, time_s, sample_id) AS dq FROM c_tele)
  GROUP BY cell_id)"""

PARTS["c_cap"] = """
SELECT f.*, d.discharge_sign, d.dis_dur_s, d.quasi_cc,
       greatest(f.max_voltage - f.min_voltage, 0e0) AS vdrop
FROM c_facts f JOIN (
  SELECT cell_id, cycleNumber, max(discharge_sign) AS discharge_sign,
         coalesce(sum(dt) FILTER (WHERE i_std < -50), 0e0) AS dis_dur_s,
         coalesce(stddev_samp(i_std) FILTER (WHERE i_std < -50)
           / (abs(avg(i_std) FILTER (WHERE i_std < -50)) + 1e-6) <= 0.3e0, false) AS quasi_cc
  FROM (SELECT s.*, g.discharge_sign, s.I_mA * (-g.discharge_sign) AS i_std
        FROM c_smp s JOIN c_sign g ON g.cell_id = s.cell_id)
  GROUP BY cell_id, cycleNumber) d
ON d.cell_id = f.cell_id AND d.cycleNumber = f.cycleNumber"""

PARTS["c_scored"] = """
SELECT c.*,
       CAST(frac_flight < 0.02e0 AS INTEGER)
       + CAST(dis_dur_s > greatest(1200e0, 1.8e0 * coalesce(md, 800e0)) AS INTEGER)
       + CAST(QDischarge_mAh >= greatest(q90, 0.9e0 * qmax) AS INTEGER)
       + CAST(quasi_cc AS INTEGER)
       + CAST(min_voltage <= 3e0 OR vdrop >= 0.8e0 AS INTEGER) AS score
FROM c_cap c JOIN (
  SELECT cell_id AS rc, quantile_cont(dis_dur_s, 0.5) FILTER (WHERE frac_flight > 0.2e0) AS md,
         quantile_cont(QDischarge_mAh, 0.9) AS q90, max(QDischarge_mAh) AS qmax
  FROM c_cap GROUP BY cell_id) r ON r.rc = c.cell_id"""

PARTS["c_tested"] = """
SELECT * EXCLUDE (found, k),
       score >= 3 OR (NOT found AND frac_flight < 0.02e0 AND k <= 2) AS is_capacity_test
FROM (
  SELECT *, max(score) OVER (PARTITION BY cell_id) >= 3 AS found,
         row_number() OVER (PARTITION BY cell_id, frac_flight < 0.02e0
           ORDER BY score DESC, QDischarge_mAh DESC NULLS LAST, cycleNumber) AS k
  FROM c_scored)"""

PARTS["c_soh"] = """
SELECT * EXCLUDE (m, before_pos, after_pos, before_val, after_val),
       CASE WHEN m IS NOT NULL THEN m WHEN before_pos IS NULL THEN after_val
            WHEN after_pos IS NULL THEN before_val
            ELSE before_val + (after_val - before_val)
                 * ((pos - before_pos) / CAST(after_pos - before_pos AS DOUBLE)) END AS SOH_pct
FROM (
  SELECT *, last_value(m IGNORE NULLS) OVER up AS before_val,
         first_value(m IGNORE NULLS) OVER down AS after_val,
         max(CASE WHEN m IS NOT NULL THEN pos END) OVER up AS before_pos,
         min(CASE WHEN m IS NOT NULL THEN pos END) OVER down AS after_pos
  FROM (
    SELECT t.*, i.initial_capacity_mAh,
           row_number() OVER (PARTITION BY t.cell_id ORDER BY cycleNumber) - 1 AS pos,
           CASE WHEN is_capacity_test THEN QDischarge_mAh / initial_capacity_mAh * 100e0 END AS m
    FROM c_tested t LEFT JOIN (
      SELECT cell_id, quantile_cont(QDischarge_mAh, 0.5) AS initial_capacity_mAh FROM (
        SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycleNumber) AS k
        FROM c_tested WHERE is_capacity_test AND QDischarge_mAh IS NOT NULL)
      WHERE k <= 3 GROUP BY cell_id) i ON i.cell_id = t.cell_id)
  WINDOW up AS (PARTITION BY cell_id ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY cell_id ORDER BY pos
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

PARTS["c_cycles"] = """
SELECT *, CAST(coalesce(CASE WHEN eol_cycle IS NOT NULL THEN greatest(eol_cycle - cycleNumber, 0)
                        END, last_cycle - cycleNumber) AS DOUBLE) AS RUL_cycles,
       eol_cycle IS NULL AS RUL_censored, anomaly_score > 0 AS any_anomaly
FROM (
  SELECT *, min(CASE WHEN SOH_pct_smoothed < 85e0 THEN cycleNumber END) OVER c AS eol_cycle,
         max(cycleNumber) OVER c AS last_cycle,
         min(CASE WHEN SOH_pct_smoothed < 85e0 THEN mission_id END) OVER c AS first_eol_mission,
         max(mission_id) OVER c AS last_mission_id,
         CAST(coalesce(min_voltage < 2.5e0 OR max_voltage > 4.3e0, false) AS INTEGER)
         + CAST(coalesce(duration_s < 0.1e0 * greatest(1e0, typical), false) AS INTEGER)
         + CAST(coalesce(max_jump_V > 0.5e0, false) AS INTEGER) AS anomaly_score
  FROM (
    SELECT s.*, quantile_cont(SOH_pct, 0.5) OVER (PARTITION BY s.cell_id ORDER BY cycleNumber
                  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS SOH_pct_smoothed,
           CASE WHEN is_mission THEN CAST(sum(CAST(is_mission AS INTEGER)) OVER (
             PARTITION BY s.cell_id ORDER BY cycleNumber) AS INTEGER) END AS mission_id,
           q.typical
    FROM c_soh s JOIN (SELECT cell_id, quantile_cont(duration_s, 0.5) AS typical
                       FROM c_facts GROUP BY cell_id) q ON q.cell_id = s.cell_id)
  WINDOW c AS (PARTITION BY cell_id))"""

PARTS["c_soc"] = f"""
SELECT s.*, {case(fixed.PHASES, 's.Ns', 'unknown')} AS phase, 'Ns' AS phase_source,
       y.discharge_sign,
       least(greatest(100e0 + sum(s.I_mA * (-y.discharge_sign) * s.dt_h) OVER (
         PARTITION BY s.cell_id, s.cycleNumber ORDER BY s.time_s, s.sample_id)
         / (y.SOH_pct / 100e0 * y.initial_capacity_mAh) * 100e0, 0e0), 100e0) AS SOC
FROM c_smp s JOIN c_cycles y ON y.cell_id = s.cell_id AND y.cycleNumber = s.cycleNumber"""

PARTS["c_seg"] = """
SELECT *, CAST(sum(CASE WHEN nth = 1 THEN CAST(Ns IS NULL AS INTEGER)
                   WHEN Ns IS NULL OR prev_ns IS NULL OR Ns <> prev_ns THEN 1 ELSE 0 END) OVER (
         PARTITION BY cell_id, cycleNumber ORDER BY time_s, sample_id) AS INTEGER) AS seg_id
FROM c_soc"""

PARTS["c_tot"] = f"""
SELECT *, {family('phase_name')} AS phase_family FROM (
  SELECT cell_id, cycleNumber, seg_id, Ns, max(phase) AS phase_name,
         min(time_s) AS t_start_s, max(time_s) AS t_end_s, sum(dt) AS duration_s,
         sum(power_W * dt / 3600e0) AS energy_Wh, avg(power_W) AS mean_power_W,
         max(power_W) AS max_power_W, avg(abs(power_W)) AS mean_abs_power_W,
         avg(I_mA) AS mean_I_mA, max(I_mA) AS max_I_mA, min(I_mA) AS min_I_mA,
         avg(Temperature__C) AS mean_temp_C, max(Temperature__C) AS max_temp_C,
         min_by(SOC, time_s) FILTER (WHERE SOC IS NOT NULL) AS start_SOC,
         max_by(SOC, time_s) FILTER (WHERE SOC IS NOT NULL) AS end_SOC,
         max(discharge_sign) AS discharge_sign
  FROM c_seg WHERE Ns IS NOT NULL GROUP BY cell_id, cycleNumber, seg_id, Ns)"""

PARTS["c_phases"] = f"""
SELECT *, abs(mean_I_mA) / 1000e0 / cap_Ah AS mean_C_rate,
       greatest(abs(max_I_mA), abs(min_I_mA)) / 1000e0 / cap_Ah AS max_C_rate,
       (max_temp_C - mean_temp_C) / greatest(duration_s, 1e0) AS thermal_slope_K_per_s,
       CASE WHEN mean_abs_power_W >= 1e0 THEN
         (max_temp_C - mean_temp_C) / greatest(duration_s, 1e0) / mean_abs_power_W END
         AS thermal_gain_K_per_W
FROM (
  SELECT t.*, y.SOH_pct_smoothed AS SOH_cycle_pct, y.mission_id,
         y.SOH_pct_smoothed AS start_SOH_pct, y.SOH_pct_smoothed AS end_SOH_pct,
         0e0 AS delta_SOH_pct, y.SOH_pct_smoothed AS SOH_mission_end_pct,
         coalesce(y.SOH_pct_smoothed / 100e0 * (y.initial_capacity_mAh / 1000e0),
                  y.initial_capacity_mAh / 1000e0) AS cap_Ah,
         t.end_SOC - t.start_SOC AS delta_SOC,
         y.mission_id IS NOT NULL AS is_mission_cycle,
         phase_family = 'charge' AS is_charge_phase, phase_family = 'flight' AS is_flight_phase,
         phase_family = 'rest' AS is_rest_phase, phase_family = 'transition' AS is_transition,
         CASE WHEN y.mission_id IS NOT NULL THEN CAST(row_number() OVER (
           PARTITION BY t.cell_id, y.mission_id ORDER BY t.t_start_s, t.cycleNumber, t.seg_id)
           AS INTEGER) END AS phase_order_in_mission,
         CAST(greatest(coalesce(y.first_eol_mission, y.last_mission_id) - y.mission_id, 0)
              + 0 * y.mission_id AS DOUBLE) AS RUL_missions_after_phase,
         y.first_eol_mission IS NULL AS RUL_missions_censored,
         {case(fixed.CONDITIONS, 't.cell_id', 'unknown')} AS cell_condition
  FROM c_tot t JOIN c_cycles y ON y.cell_id = t.cell_id AND y.cycleNumber = t.cycleNumber)"""

def list_quantile(values: str, prob: str) -> str:
    rank = f"({prob} * (len({values}) - 1))"
    low = f"{values}[CAST(floor({rank}) AS BIGINT) + 1]"
    high = f"{values}[CAST(ceil({rank}) AS BIGINT) + 1]"
    part = f"({rank} - floor({rank}))"
    return (f"CASE WHEN {part} >= 0.5e0 THEN {high} - ({high} - {low}) * (1e0 - {part}) "
            f"ELSE {low} + ({high} - {low}) * {part} END")


PARTS["c_span"] = f"""
SELECT * EXCLUDE (v) FROM (
  SELECT cell_id, cycleNumber, seg_id, v, {list_quantile('v', '0.02e0')} AS vmin,
         {list_quantile('v', '0.98e0')} AS vmax
  FROM (SELECT cell_id, cycleNumber, seg_id, list_sort(list(Ecell_V)) AS v
        FROM c_seg WHERE Ns IS NOT NULL GROUP BY cell_id, cycleNumber, seg_id
        HAVING count(*) >= 8))
WHERE vmax - vmin >= 0.05e0"""

PARTS["c_icbase"] = """
SELECT s.cell_id, s.cycleNumber, s.seg_id, g.vmin, g.vmax,
       CASE WHEN s.Ecell_V >= g.vmax THEN 60 ELSE CAST(len(list_filter(range(60), lambda i:
         i * ((g.vmax - g.vmin) / 60e0) + g.vmin <= s.Ecell_V)) - 1 AS INTEGER) END AS bin,
       s.I_mA * (coalesce(s.time_s - lag(s.time_s) OVER (
         PARTITION BY s.cell_id, s.cycleNumber, s.seg_id ORDER BY s.time_s, s.sample_id), 0e0)
         / 3600e0) AS dq
FROM c_seg s JOIN c_span g
  ON g.cell_id = s.cell_id AND g.cycleNumber = s.cycleNumber AND g.seg_id = s.seg_id"""

PARTS["c_ichist"] = """
SELECT cell_id, cycleNumber, seg_id, bin, max(vmin) AS vmin, max(vmax) AS vmax,
       sum(dq) AS charge_mAh
FROM c_icbase WHERE bin >= 0 AND bin < 60 GROUP BY cell_id, cycleNumber, seg_id, bin"""

PARTS["c_iccurve"] = """
SELECT s.cell_id, s.cycleNumber, s.seg_id, b.bin,
       s.vmin + (b.bin + 0.5e0) * ((s.vmax - s.vmin) / 60e0) AS mid,
       coalesce(h.charge_mAh, 0e0) / greatest((s.vmax - s.vmin) / 60e0, 1e-6) AS ic
FROM (SELECT cell_id, cycleNumber, seg_id, max(vmin) AS vmin, max(vmax) AS vmax FROM c_ichist
      GROUP BY cell_id, cycleNumber, seg_id) s
CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(60)) b
LEFT JOIN c_ichist h ON h.cell_id = s.cell_id AND h.cycleNumber = s.cycleNumber
  AND h.seg_id = s.seg_id AND h.bin = b.bin"""

PARTS["c_ic"] = """
SELECT c.cell_id, c.cycleNumber, c.seg_id, max(m.centroid) AS ic_centroid_V,
       sqrt(sum((mid - m.centroid) * (mid - m.centroid) * abs(ic) / m.total)) AS ic_spread_V,
       max(mid) FILTER (WHERE k = 1) AS ic_peak1_V, max(ic) FILTER (WHERE k = 1)
         AS ic_peak1_height,
       max(mid) FILTER (WHERE k = 2) AS ic_peak2_V, max(ic) FILTER (WHERE k = 2)
         AS ic_peak2_height
FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, cycleNumber, seg_id
        ORDER BY abs(ic) DESC, bin DESC) AS k FROM c_iccurve) c
JOIN (SELECT cell_id, cycleNumber, seg_id, sum(abs(ic)) AS total,
             sum(mid * abs(ic)) / sum(abs(ic)) AS centroid
      FROM c_iccurve GROUP BY cell_id, cycleNumber, seg_id HAVING sum(abs(ic)) > 0) m
  ON m.cell_id = c.cell_id AND m.cycleNumber = c.cycleNumber AND m.seg_id = c.seg_id
GROUP BY c.cell_id, c.cycleNumber, c.seg_id"""

PARTS["c_vi"] = """
SELECT cell_id, cycleNumber, seg_id, -regr_slope(Ecell_V, I_mA / 1000e0) AS vi_slope_R_ohm
FROM c_seg WHERE Ns IS NOT NULL GROUP BY cell_id, cycleNumber, seg_id
HAVING count(*) >= 12 AND stddev_pop(I_mA / 1000e0) >= 0.05e0"""

PARTS["c_pf"] = """
SELECT p.*, i.ic_centroid_V, i.ic_spread_V, i.ic_peak1_V, i.ic_peak1_height, i.ic_peak2_V,
       i.ic_peak2_height, v.vi_slope_R_ohm
FROM c_phases p
LEFT JOIN c_ic i ON i.cell_id = p.cell_id AND i.cycleNumber = p.cycleNumber
  AND i.seg_id = p.seg_id
LEFT JOIN c_vi v ON v.cell_id = p.cell_id AND v.cycleNumber = p.cycleNumber
  AND v.seg_id = p.seg_id
WHERE p.duration_s >= 2e0"""

PARTS["c_ms"] = f"""
SELECT *, CASE WHEN SOH_next_pct IS NOT NULL THEN greatest(SOH_end_pct - SOH_next_pct, 0e0) END
         AS dSOH_drop_pct
FROM (
  SELECT *, abs(energy_flight_Wh) AS flight_Wh_abs,
         abs(energy_flight_Wh) / nullif(energy_charge_Wh, 0e0) AS eff_energy,
         cv_duration_s / nullif(cc_duration_s + cv_duration_s, 0e0) AS cv_fraction,
         cc_duration_s / nullif(cc_duration_s + cv_duration_s, 0e0) AS cc_fraction,
         cv_energy_Wh / 4.19e0 / nullif(cv_duration_s / 3600e0, 0e0) AS cv_mean_I_A_proxy,
         lead(SOH_end_pct) OVER (PARTITION BY cell_id ORDER BY mission_id) AS SOH_next_pct,
         mission_id = max(mission_id) OVER (PARTITION BY cell_id) AS is_last_mission
  FROM (
    SELECT cell_id, mission_id, count(seg_id) AS n_segments,
           {', '.join(fam_sum('duration_s', f) + f' AS dur_{f}_s' for f in FAMILIES)},
           {fam_sum('energy_Wh', 'flight')} AS energy_flight_Wh,
           {fam_sum('energy_Wh', 'charge')} AS energy_charge_Wh,
           quantile_cont(thermal_gain_K_per_W, 0.5) AS th_gain_med,
           max(thermal_gain_K_per_W) AS th_gain_max,
           quantile_cont(vi_slope_R_ohm, 0.5) AS R_ohm_med,
           quantile_cont(vi_slope_R_ohm, 0.9) AS R_ohm_p90,
           quantile_cont(ic_centroid_V, 0.5) AS ic_centroid_V,
           quantile_cont(ic_spread_V, 0.5) AS ic_spread_V,
           quantile_cont(ic_peak1_V, 0.5) AS ic_p1_V,
           quantile_cont(ic_peak1_height, 0.5) AS ic_p1_h,
           max(SOH_mission_end_pct) AS SOH_end_pct,
           {phase_total('duration_s', 'CC')} AS cc_duration_s,
           {phase_total('duration_s', 'CV')} AS cv_duration_s,
           {phase_total('energy_Wh', 'CV')} AS cv_energy_Wh
    FROM c_pf WHERE mission_id IS NOT NULL GROUP BY cell_id, mission_id))"""

PARTS["c_mt"] = f"""
SELECT *, abs(energy_flight_Wh) AS flight_Wh_abs,
       CASE WHEN SOH_next_pct IS NOT NULL THEN greatest(SOH_end_pct - SOH_next_pct, 0e0) END
         AS dSOH_drop_pct
FROM (
  SELECT cell_id, mission_id, count(seg_id) AS n_segments,
         {', '.join(fam_sum('energy_Wh', f) + f' AS energy_{f}_Wh' for f in FAMILIES)},
         {phase_total('duration_s', 'Take-off')} AS dur_takeoff_s,
         {phase_total('duration_s', 'Cruise')} AS dur_cruise_s,
         {phase_total('duration_s', 'Landing')} AS dur_landing_s,
         {phase_total('duration_s', 'CC')} AS dur_cc_s,
         {phase_total('duration_s', 'CV')} AS dur_cv_s,
         {phase_total('duration_s', 'Rest1 (post-landing)')} AS dur_rest1_s,
         {phase_total('duration_s', 'Rest2 (pre-charge)')} AS dur_rest2_s,
         avg(mean_temp_C) AS mean_temp_C, max(max_temp_C) AS max_temp_C,
         avg(mean_C_rate) AS mean_C_rate, max(max_C_rate) AS max_C_rate,
         max(SOH_mission_end_pct) AS SOH_end_pct,
         lead(max(SOH_mission_end_pct)) OVER (PARTITION BY cell_id ORDER BY mission_id)
           AS SOH_next_pct
  FROM c_phases WHERE mission_id IS NOT NULL GROUP BY cell_id, mission_id)"""

PARTS["c_accept"] = """
SELECT *, cv_duration_s / nullif(cc_duration_s + cv_duration_s, 0e0) AS cv_fraction,
       cc_duration_s / nullif(cc_duration_s + cv_duration_s, 0e0) AS cc_fraction,
       cv_energy_Wh / 4.1e0 / nullif(cv_duration_s / 3600e0, 0e0) AS cv_mean_I_A_proxy
FROM (
  SELECT cell_id, mission_id,
         sum(duration_s) FILTER (WHERE phase_name = 'CC') AS cc_duration_s,
         sum(energy_Wh) FILTER (WHERE phase_name = 'CC') AS cc_energy_Wh,
         avg(mean_C_rate) FILTER (WHERE phase_name = 'CC') AS cc_mean_C,
         sum(duration_s) FILTER (WHERE phase_name = 'CV') AS cv_duration_s,
         sum(energy_Wh) FILTER (WHERE phase_name = 'CV') AS cv_energy_Wh,
         avg(mean_C_rate) FILTER (WHERE phase_name = 'CV') AS cv_mean_C
  FROM c_phases WHERE mission_id IS NOT NULL AND phase_name IN ('CC', 'CV')
  GROUP BY cell_id, mission_id)"""

PARTS["c_fam"] = f"""
SELECT *, abs(energy_flight_Wh) / nullif(energy_charge_Wh, 0e0) AS eff_energy FROM (
  SELECT cell_id, mission_id,
         {', '.join(fam_sum('energy_Wh', f) + f' AS energy_{f}_Wh' for f in FAMILIES)},
         {', '.join(fam_sum('duration_s', f) + f' AS dur_{f}_s' for f in FAMILIES)}
  FROM c_phases WHERE mission_id IS NOT NULL GROUP BY cell_id, mission_id)"""

PARTS["c_deg"] = """
SELECT f.*, a.* EXCLUDE (cell_id, mission_id), l.* EXCLUDE (cell_id, mission_id)
FROM c_fam f
LEFT JOIN c_accept a ON a.cell_id = f.cell_id AND a.mission_id = f.mission_id
LEFT JOIN (SELECT cell_id, mission_id, max(SOH_mission_end_pct) AS SOH_mission_end_pct,
                  max(RUL_missions_after_phase) AS RUL_missions_after_phase,
                  bool_or(RUL_missions_censored) AS RUL_missions_censored
           FROM c_phases WHERE mission_id IS NOT NULL GROUP BY cell_id, mission_id) l
  ON l.cell_id = f.cell_id AND l.mission_id = f.mission_id"""

PARTS["c_stress"] = """
SELECT phase_name, count(seg_id) AS n, quantile_cont(duration_s, 0.5) AS median_dur_s,
       quantile_cont(energy_Wh, 0.5) AS median_energy_Wh, avg(mean_C_rate) AS mean_mean_C,
       avg(max_temp_C) AS mean_max_T
FROM c_phases WHERE duration_s >= 2e0 GROUP BY phase_name"""

PARTS["c_mtlong"] = unpivot("c_mt WHERE dSOH_drop_pct IS NOT NULL",
                            "cell_id, mission_id, dSOH_drop_pct AS y", fixed.DSOH_FEATURES)

PARTS["c_spear"] = """
SELECT feature, count(x) AS n, CASE WHEN count(x) >= 5 AND min(x) < max(x) AND min(y) < max(y)
       THEN corr(rx, ry) END AS spearman_r
FROM (
  SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY feature ORDER BY x)
              + (count(*) OVER (PARTITION BY feature, x) - 1) / 2e0 END AS rx,
         rank() OVER (PARTITION BY feature ORDER BY y)
           + (count(*) OVER (PARTITION BY feature, y) - 1) / 2e0 AS ry
  FROM c_mtlong) GROUP BY feature"""

PARTS["c_boxlong"] = unpivot("c_phases", "phase_name", fixed.BOX_FEATURES)

PARTS["c_box"] = """
SELECT b.phase_name, b.feature, max(q.n) AS n, max(q.q1) AS q1, max(q.median) AS median,
       max(q.q3) AS q3,
       least(min(x) FILTER (WHERE x >= q1 - 1.5e0 * (q3 - q1)), max(q1)) AS whisker_low,
       greatest(max(x) FILTER (WHERE x <= q3 + 1.5e0 * (q3 - q1)), max(q3)) AS whisker_high
FROM c_boxlong b JOIN (
  SELECT phase_name, feature, count(x) AS n, quantile_cont(x, 0.25) AS q1,
         quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
  FROM c_boxlong WHERE x IS NOT NULL GROUP BY phase_name, feature) q
ON q.phase_name = b.phase_name AND q.feature = b.feature
WHERE x IS NOT NULL GROUP BY b.phase_name, b.feature"""

PARTS["c_histlong"] = unpivot("c_deg", "cell_id", fixed.HISTOGRAM_FEATURES)

PARTS["c_hist"] = """
SELECT s.feature, b.bin, s.lo + b.bin * ((s.hi - s.lo) / 20e0) AS bin_low,
       s.lo + (b.bin + 1) * ((s.hi - s.lo) / 20e0) AS bin_high, count(h.x) AS n
FROM (SELECT feature, CASE WHEN min(x) = max(x) THEN min(x) - 0.5e0 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5e0 ELSE max(x) END AS hi
      FROM c_histlong GROUP BY feature) s
CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b
LEFT JOIN c_histlong h ON h.feature = s.feature
  AND least(floor((h.x - s.lo) * 20e0 / (s.hi - s.lo)), 19) = b.bin
GROUP BY s.feature, b.bin, s.lo, s.hi"""

PARTS["c_trend"] = """
SELECT cell_id, phase_name, mission_id, quantile_cont(thermal_gain_K_per_W, 0.5) AS med_gain,
       quantile_cont(delta_SOC, 0.5) AS med_dsoc, count(seg_id) AS n
FROM c_phases WHERE mission_id IS NOT NULL GROUP BY cell_id, phase_name, mission_id"""

PARTS["c_setpoint"] = """
SELECT cell_id, v95, CASE WHEN abs(v95 - 4.0e0) <= 0.05e0 THEN 4.0e0
                          WHEN abs(v95 - 4.1e0) <= 0.05e0 THEN 4.1e0
                          WHEN abs(v95 - 4.2e0) <= 0.05e0 THEN 4.2e0
                          ELSE round(v95, 2) END AS cv_setpoint_V
FROM (SELECT cell_id, quantile_cont(Ecell_V, 0.95) AS v95 FROM c_tele WHERE Ns = 1
      GROUP BY cell_id)"""


def _only(cond: str, value: str, name: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END AS {name}"


_CHG, _DIS = "phase_family = 'charge'", "phase_family = 'flight'"
PARTS["c_dp"] = f"""
SELECT cell_id, cycleNumber, seg_id, mission_id, phase_name, phase_family, cell_condition,
       SOH_mission_end_pct, RUL_missions_after_phase,
       CAST({_CHG} AS INTEGER) AS chg_is_charge_phase,
       CAST(phase_name = 'CC' AS INTEGER) AS chg_is_CC,
       CAST(phase_name = 'CV' AS INTEGER) AS chg_is_CV,
       {_only(_CHG, 'duration_s', 'chg_dur_s')}, {_only(_CHG, 'energy_Wh', 'chg_energy_Wh')},
       {_only("phase_name = 'CC'", 'duration_s', 'chg_cc_dur_s')},
       {_only("phase_name = 'CV'", 'duration_s', 'chg_cv_dur_s')},
       {_only("phase_name = 'CV'", 'energy_Wh', 'chg_cv_energy_Wh')},
       {_only(_CHG, 'mean_C_rate', 'chg_mean_C_rate')},
       {_only(_CHG, 'max_C_rate', 'chg_max_C_rate')},
       {_only(_CHG, 'ic_centroid_V', 'chg_ic_centroid_V')},
       {_only(_CHG, 'ic_spread_V', 'chg_ic_spread_V')},
       {_only(_CHG, 'ic_peak1_V', 'chg_ic_p1_V')},
       {_only(_CHG, 'ic_peak1_height', 'chg_ic_p1_h')},
       {_only(_CHG, 'vi_slope_R_ohm', 'chg_vi_R_ohm')},
       CAST({_DIS} AS INTEGER) AS dis_is_flight_phase,
       {_only(_DIS, 'duration_s', 'dis_dur_s')},
       {_only(_DIS, 'abs(energy_Wh)', 'dis_energy_Wh_abs')},
       {_only(_DIS, 'mean_C_rate', 'dis_mean_C_rate')},
       {_only(_DIS, 'max_C_rate', 'dis_max_C_rate')},
       {_only(_DIS, 'ic_centroid_V', 'dis_ic_centroid_V')},
       {_only(_DIS, 'ic_spread_V', 'dis_ic_spread_V')},
       {_only(_DIS, 'ic_peak1_V', 'dis_ic_p1_V')},
       {_only(_DIS, 'ic_peak1_height', 'dis_ic_p1_h')},
       {_only(_DIS, 'vi_slope_R_ohm', 'dis_vi_R_ohm')},
       {_only(_DIS, 'delta_SOC', 'dis_dSOC')},
       {_only(_DIS, '(-discharge_sign) * mean_I_mA / 1000e0 * duration_s / 3600e0 / cap_Ah '
                    '* 100e0', 'dis_dSOC_baseline')},
       mean_temp_C AS temp_mean_C, max_temp_C AS temp_max_C,
       thermal_slope_K_per_s AS temp_thermal_slope, thermal_gain_K_per_W AS temp_thermal_gain
FROM c_pf"""


def _sum0(name: str) -> str:
    return f"coalesce(sum({name}), 0e0)"


PARTS["c_dm"] = f"""
SELECT d.*, s.cv_setpoint_V, d.SOH_mission_end_pct AS SOH_end_pct,
       chg_cv_dur_s / nullif(chg_cc_dur_s + chg_cv_dur_s, 0e0) AS chg_cv_fraction,
       chg_cv_energy_Wh / 4.19e0 / nullif(chg_cv_dur_s / 3600e0, 0e0) AS chg_cv_mean_I_A_proxy,
       sum(chg_energy_Wh) OVER w AS chg_cum_Wh, sum(dis_flight_Wh_abs) OVER w AS dis_cum_Wh,
       row_number() OVER w - 1 AS mission_pos,
       count(*) OVER (PARTITION BY d.cell_id) AS n_missions
FROM (
  SELECT cell_id, mission_id, {_sum0('chg_dur_s')} AS chg_total_dur_s,
         {_sum0('chg_cc_dur_s')} AS chg_cc_dur_s, {_sum0('chg_cv_dur_s')} AS chg_cv_dur_s,
         {_sum0('chg_energy_Wh')} AS chg_energy_Wh,
         {_sum0('chg_cv_energy_Wh')} AS chg_cv_energy_Wh,
         {_sum0('dis_dur_s')} AS dis_total_dur_s,
         {_sum0('dis_energy_Wh_abs')} AS dis_flight_Wh_abs,
         quantile_cont(dis_mean_C_rate, 0.5) AS dis_mean_C_rate_med,
         quantile_cont(dis_max_C_rate, 0.9) AS dis_max_C_rate_p90,
         quantile_cont(dis_vi_R_ohm, 0.5) AS dis_vi_R_ohm_med,
         quantile_cont(dis_vi_R_ohm, 0.9) AS dis_vi_R_ohm_p90,
         {_sum0('dis_dSOC')} AS dis_dSOC_sum, {_sum0('dis_dSOC_baseline')}
           AS dis_dSOC_baseline_sum,
         quantile_cont(temp_mean_C, 0.5) AS temp_mean_C_med, max(temp_max_C) AS temp_max_C_max,
         quantile_cont(temp_thermal_gain, 0.5) AS temp_th_gain_med,
         max(temp_thermal_gain) AS temp_th_gain_max,
         max(SOH_mission_end_pct) AS SOH_mission_end_pct,
         quantile_cont(RUL_missions_after_phase, 0.5) AS RUL_med,
         max(cell_condition) AS cell_condition
  FROM c_dp WHERE mission_id IS NOT NULL GROUP BY cell_id, mission_id) d
LEFT JOIN c_setpoint s ON s.cell_id = d.cell_id
WINDOW w AS (PARTITION BY d.cell_id ORDER BY mission_id)"""

# missions with filled features and condition columns
PARTS["c_mrow"] = f"""
SELECT cell_id, mission_id, mission_pos, n_missions, SOH_end_pct, {filled(MISSION_MODEL)},
       {one_hot('cell_condition', CONDITION_VALUES)}
FROM c_dm"""

PARTS["c_horizon"] = """
SELECT * FROM (
  SELECT *, lead(SOH_end_pct, 5) OVER (PARTITION BY cell_id ORDER BY mission_id) AS SOH_future,
         greatest(SOH_end_pct - lead(SOH_end_pct, 5) OVER (
           PARTITION BY cell_id ORDER BY mission_id), 0e0) AS dSOH_to_future,
         max(mission_id) OVER (PARTITION BY cell_id) AS last_id
  FROM c_mrow) WHERE mission_id <= last_id - 5"""

PARTS["c_rul"] = """
SELECT m.*, e.eol, f.first_pos IS NULL AS RUL_censored,
       CAST(CASE WHEN f.first_pos IS NOT NULL THEN greatest(f.first_pos - m.mission_pos, 0)
            ELSE m.n_missions - 1 - m.mission_pos END AS DOUBLE) AS RUL_missions
FROM c_mrow m CROSS JOIN (SELECT unnest([80, 85, 90]) AS eol) e
LEFT JOIN (SELECT cell_id, eol, min(mission_pos) AS first_pos
           FROM c_mrow CROSS JOIN (SELECT unnest([80, 85, 90]) AS eol)
           WHERE SOH_end_pct < eol GROUP BY cell_id, eol) f
  ON f.cell_id = m.cell_id AND f.eol = e.eol"""


def window_sql(source: str, keys: str, part: str, order: str, steps: int, features: list[str],
               label: str, extra: str = "") -> str:
    total = " + ".join(quoted(f) for f in features)
    return f"""
SELECT {keys}, {extra} CAST(count(*) OVER w AS INTEGER) AS length, {label} AS label,
       sum({total}) OVER w AS steps_sum, first_value({total}) OVER w AS first_step_sum,
       {total} AS last_step_sum
FROM {source}
WINDOW w AS (PARTITION BY {part} ORDER BY {order}
             ROWS BETWEEN {steps - 1} PRECEDING AND CURRENT ROW)"""


PARTS["c_socrow"] = f"""
SELECT cell_id, mission_id, cycleNumber, seg_id, dis_dSOC AS label, {filled(PHASE_MODEL)},
       {one_hot('cell_condition', CONDITION_VALUES)},
       row_number() OVER (PARTITION BY cell_id, mission_id ORDER BY cycleNumber, seg_id) - 1
         AS nth
FROM c_dp WHERE mission_id IS NOT NULL AND dis_is_flight_phase = 1"""

PARTS["c_socseq"] = "SELECT * FROM (" + window_sql(
    "c_socrow", "cell_id, mission_id, seg_id", "cell_id, mission_id", "cycleNumber, seg_id",
    fixed.SOC_STEPS, PHASE_MODEL_ALL, "label", "nth,") + ") WHERE nth > 0"

PARTS["c_sohseq"] = window_sql(
    "c_horizon", "cell_id, mission_id", "cell_id", "mission_id", fixed.MISSION_STEPS,
    MISSION_MODEL_ALL, "dSOH_to_future")

PARTS["c_rulseq"] = window_sql(
    "c_rul", "cell_id, mission_id, eol", "cell_id, eol", "mission_id", fixed.MISSION_STEPS,
    MISSION_MODEL_ALL, "RUL_missions")

PARTS["c_mlong"] = unpivot("c_mrow", "cell_id, mission_id, mission_pos", MISSION_MODEL_ALL)

PARTS["c_scaler"] = """
SELECT l.feature, count(*) AS n_steps, avg(l.x) AS mean,
       CASE WHEN stddev_pop(l.x) < 1e-12 THEN 1e0 ELSE stddev_pop(l.x) END AS std
FROM c_mlong l JOIN (SELECT cell_id, mission_pos AS ends FROM c_mrow) t
  ON t.cell_id = l.cell_id AND l.mission_pos BETWEEN t.ends - 19 AND t.ends
GROUP BY l.feature"""

PARTS["c_pool"] = """
SELECT cell_id, mission_id, feature, x AS last, avg(x) OVER w AS mean, min(x) OVER w AS min,
       max(x) OVER w AS max, CASE WHEN count(*) OVER w < 2 THEN 0e0
         ELSE regr_slope(x, CAST(mission_pos AS DOUBLE)) OVER w END AS slope
FROM c_mlong
WINDOW w AS (PARTITION BY cell_id, feature ORDER BY mission_pos
             ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""

PARTS["c_pred"] = """
SELECT cell_id, mission_id, eol, RUL_missions AS y_true,
       RUL_missions + ((mission_id * 37 + eol * 7) % 11) - 5e0 AS y_pred
FROM c_rul"""

PARTS["c_cellmet"] = """
SELECT eol, cell_id, avg(abs(y_pred - y_true)) AS MAE,
       sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS RMSE, count(*) AS N
FROM c_pred GROUP BY eol, cell_id"""

PARTS["c_wide"] = """
SELECT cell_id, mission_id, max(y_pred) FILTER (WHERE eol = 80) AS p80,
       max(y_pred) FILTER (WHERE eol = 85) AS p85, max(y_pred) FILTER (WHERE eol = 90) AS p90
FROM c_pred GROUP BY cell_id, mission_id HAVING count(DISTINCT eol) = 3"""

# the feasible pooling with the least squared error is the isotonic fit
PARTS["c_iso"] = """
SELECT * EXCLUDE (k) FROM (
  SELECT cell_id, mission_id, p80, p85, p90, f80, f85, f90,
         row_number() OVER (PARTITION BY cell_id, mission_id ORDER BY
           (p80 - f80) * (p80 - f80) + (p85 - f85) * (p85 - f85) + (p90 - f90) * (p90 - f90)) AS k
  FROM (
    SELECT *, p80 AS f80, p85 AS f85, p90 AS f90 FROM c_wide
    UNION ALL
    SELECT *, (p80 + p85) / 2e0, (p80 + p85) / 2e0, p90 FROM c_wide
    UNION ALL
    SELECT *, p80, (p85 + p90) / 2e0, (p85 + p90) / 2e0 FROM c_wide
    UNION ALL
    SELECT *, (p80 + p85 + p90) / 3e0, (p80 + p85 + p90) / 3e0, (p80 + p85 + p90) / 3e0
    FROM c_wide)
  WHERE f80 >= f85 AND f85 >= f90) WHERE k = 1"""

PARTS["c_isolong"] = """
SELECT p.*, CASE p.eol WHEN 80 THEN f80 WHEN 85 THEN f85 ELSE f90 END AS y_pred_cal
FROM c_pred p JOIN c_iso i ON i.cell_id = p.cell_id AND i.mission_id = p.mission_id"""

PARTS["c_sohpred"] = """
SELECT cell_id, mission_id, SOH_end_pct AS SOH_now, dSOH_to_future AS y_true,
       dSOH_to_future + ((mission_id * 13) % 7 - 3) / 10e0 AS y_pred
FROM c_horizon"""

PARTS["c_size"] = "SELECT cell_id, count(*) AS n FROM c_horizon GROUP BY cell_id"

PARTS["c_queue"] = """
SELECT h.cell_id AS hold, c.cell_id, c.n,
       row_number() OVER (PARTITION BY h.cell_id ORDER BY c.n DESC, c.cell_id DESC) AS k,
       least(3, greatest(2, count(*) OVER (PARTITION BY h.cell_id))) AS parts
FROM c_size h JOIN c_size c ON c.cell_id <> h.cell_id"""

PARTS["c_deal"] = """
SELECT q.hold, q.cell_id, q.n, q.k, 0 AS fold, q.n AS a, CAST(0 AS BIGINT) AS b,
       CASE WHEN q.parts = 3 THEN CAST(0 AS BIGINT) ELSE 4611686018427387904 END AS c
FROM c_queue q WHERE q.k = 1
UNION ALL
SELECT q.hold, q.cell_id, q.n, q.k,
       CASE WHEN d.a <= d.b AND d.a <= d.c THEN 0 WHEN d.b <= d.c THEN 1 ELSE 2 END,
       CASE WHEN d.a <= d.b AND d.a <= d.c THEN d.a + q.n ELSE d.a END,
       CASE WHEN d.a <= d.b AND d.a <= d.c THEN d.b WHEN d.b <= d.c THEN d.b + q.n ELSE d.b END,
       CASE WHEN d.a <= d.b AND d.a <= d.c THEN d.c WHEN d.b <= d.c THEN d.c ELSE d.c + q.n END
FROM c_deal d JOIN c_queue q ON q.hold = d.hold AND q.k = d.k + 1"""

PARTS["c_role"] = """
SELECT hold, cell_id, n, fold, CASE WHEN fold = 0 THEN 'val' ELSE 'train' END AS role FROM c_deal
UNION ALL SELECT cell_id, cell_id, n, NULL, 'test' FROM c_size"""

PARTS["c_hlong"] = unpivot("c_horizon", "cell_id, dSOH_to_future AS y", GUARDED)

PARTS["c_corr"] = """
SELECT r.hold, l.feature, count(*) AS pairs,
       CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS corr
FROM c_hlong l JOIN c_role r ON r.cell_id = l.cell_id AND r.role = 'train'
GROUP BY r.hold, l.feature"""

# rows with missing values kept, to exercise the median fill
PARTS["c_nlong"] = unpivot(
    "c_ms WHERE NOT is_last_mission", "cell_id, dSOH_drop_pct AS y", fixed.SOH_TABLE)

PARTS["c_scale"] = """
SELECT l.hold, l.feature, max(md) AS fill, avg(coalesce(x, md)) AS center,
       CASE WHEN stddev_pop(coalesce(x, md)) < 1e-12 THEN 1e0
            ELSE stddev_pop(coalesce(x, md)) END AS scale,
       count(*) FILTER (WHERE x IS NULL) AS n_null, count(x) AS n
FROM (
  SELECT r.hold, n.feature, n.x, coalesce(quantile_cont(n.x, 0.5) OVER (
           PARTITION BY r.hold, n.feature), 0e0) AS md
  FROM c_nlong n JOIN c_role r ON r.cell_id = n.cell_id AND r.role = 'train') l
GROUP BY l.hold, l.feature"""

PARTS["c_prep"] = """
SELECT c.hold, c.feature, c.pairs, c.corr, c.pairs < 10 OR c.corr IS NULL
         OR abs(c.corr) < 0.995e0 AS kept, s.fill, s.center, s.scale
FROM c_corr c JOIN (
  SELECT r.hold, l.feature, quantile_cont(x, 0.5) AS fill, avg(x) AS center,
         CASE WHEN stddev_pop(x) < 1e-12 THEN 1e0 ELSE stddev_pop(x) END AS scale
  FROM c_hlong l JOIN c_role r ON r.cell_id = l.cell_id AND r.role = 'train'
  GROUP BY r.hold, l.feature) s ON s.hold = c.hold AND s.feature = c.feature"""

PARTS["c_arr"] = """
SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS a,
       [CAST(x AS DOUBLE) FOR x IN embedding] AS g
FROM embeddings"""

PARTS["c_att"] = """
SELECT vec_id, pos, w / (sum(w) OVER (PARTITION BY vec_id) + 1e-12) AS p FROM (
  SELECT vec_id, pos, exp(v - max(v) OVER (PARTITION BY vec_id)) AS w FROM (
    SELECT vec_id, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS pos FROM c_arr))"""

PARTS["c_gate"] = """
SELECT vec_id, pos, w / (sum(w) OVER (PARTITION BY vec_id) + 1e-12) AS p,
       w / sum(w) OVER (PARTITION BY vec_id) + 1e-8 AS pe FROM (
  SELECT vec_id, pos, exp(v - max(v) OVER (PARTITION BY vec_id)) AS w FROM (
    SELECT vec_id, unnest(g) AS v, generate_subscripts(g, 1) - 1 AS pos FROM c_arr))"""

RECURSIVE = {"c_deal"}


def needed(sql: str) -> list[str]:
    """Names of the parts ``sql`` uses, dependencies first."""
    order: list[str] = []

    def visit(body: str, owner: str | None) -> None:
        for name in sorted(set(re.findall(r"\bc_[a-z0-9]+\b", body))):
            if name in PARTS and name != owner and name not in order:
                visit(PARTS[name], name)
                order.append(name)

    visit(sql, None)
    return order


def statement(select: str) -> str:
    parts = ",\n".join(
        f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({PARTS[name]})"
        for name in needed(select))
    return f"WITH RECURSIVE {parts}\n{select}" if parts else select
