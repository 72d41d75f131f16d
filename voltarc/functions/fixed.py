"""Fixed values of the data model and the default parameters of the operators."""

from __future__ import annotations

# ---- fixed values: phase code -> phase name ----
PHASES = {
    0: "CC",
    1: "CV",
    2: "CV→Rest",
    3: "Rest→TO",
    4: "Take-off",
    5: "Cruise",
    6: "Landing",
    7: "Landing→Rest",
    8: "Rest1 (post-landing)",
    9: "Rest2 (pre-charge)",
}

# ---- fixed values: phase name -> family ----
FAMILIES = {
    "CC": "charge",
    "CV": "charge",
    "CV→Rest": "transition",
    "Rest→TO": "transition",
    "Take-off": "flight",
    "Cruise": "flight",
    "Landing": "flight",
    "Landing→Rest": "transition",
    "Rest1 (post-landing)": "rest",
    "Rest2 (pre-charge)": "rest",
}

# ---- fixed values: cell -> test condition ----
CONDITIONS = {
    "VAH01": "Baseline",
    "VAH02": "Extended cruise (1000 s)",
    "VAH05": "10% power reduction",
    "VAH06": "CC charge current C/2",
    "VAH07": "CV 4.0V",
    "VAH09": "20°C chamber",
    "VAH10": "30°C chamber",
    "VAH11": "20% power reduction",
    "VAH12": "Short cruise (400 s)",
    "VAH13": "Short cruise (600 s)",
    "VAH15": "Extended cruise (1000 s)",
    "VAH16": "CC 1.5C",
    "VAH17": "Baseline",
    "VAH20": "Charge current 1.5C",
    "VAH22": "Extended cruise (1000 s)",
    "VAH23": "CV 4.1V",
    "VAH24": "CC C/2",
    "VAH25": "20°C chamber",
    "VAH26": "Short cruise (600 s)",
    "VAH27": "Baseline",
    "VAH28": "10% power reduction",
    "VAH30": "35°C chamber",
}

# ---- fixed values: column sets that stages require ----
REQUIRED_RAW = ["time_s", "Ecell_V", "I_mA", "QDischarge_mA_h", "QCharge_mA_h",
                "Temperature__C", "cycleNumber", "Ns"]
REQUIRED_SAMPLES = ["time_s", "Ecell_V", "I_mA", "Temperature__C", "cycleNumber", "Ns",
                    "SOC", "power_W", "cell_id"]
REQUIRED_CYCLES = ["cell_id", "cycleNumber", "SOH_pct", "SOH_pct_smoothed",
                   "initial_capacity_mAh", "is_capacity_test", "RUL_cycles", "RUL_censored"]
PRUNED_SAMPLES = ["time_s", "Ecell_V", "I_mA", "Temperature__C", "cycleNumber", "Ns",
                  "power_W", "SOC"]

# ---- fixed values: columns that are keys or labels, never features ----
META_COLUMNS = ["cell_id", "mission_id", "cycleNumber", "seg_id", "phase_name", "phase_family",
                "t_start_s", "t_end_s", "RUL_missions_after_phase", "RUL_missions_censored",
                "SOH_end_pct", "SOH_next_pct", "RUL_missions", "RUL_missions85",
                "dis_dSOC", "dis_dSOC_baseline", "delta_SOC", "SOC_delta", "dSOC"]

# ---- fixed values: name patterns of leaking features (searched in the lower-cased name) ----
LEAK_PATTERNS = [r"rul", r"eol", r"remaining", r"remain", r"soh_next", r"future", r"label",
                 r"target", r"mission_id", r"cycle", r"age", r"elapsed", r"life",
                 r"percent_remaining"]

# ---- fixed values: candidate names of the state-of-charge target, best first ----
SOC_TARGETS = ["dis_dSOC", "delta_SOC", "SOC_delta", "dSOC", "dis_dSOC_baseline"]

# ---- fixed values: feature dictionary, names per level ----
PHASE_FEATURES = [
    "chg_is_charge_phase", "chg_is_CC", "chg_is_CV", "chg_dur_s", "chg_energy_Wh",
    "chg_cc_dur_s", "chg_cv_dur_s", "chg_cv_energy_Wh", "chg_mean_C_rate", "chg_max_C_rate",
    "chg_ic_centroid_V", "chg_ic_spread_V", "chg_ic_p1_V", "chg_ic_p1_h", "chg_vi_R_ohm",
    "dis_is_flight_phase", "dis_dur_s", "dis_energy_Wh_abs", "dis_mean_C_rate",
    "dis_max_C_rate", "dis_ic_centroid_V", "dis_ic_spread_V", "dis_ic_p1_V", "dis_ic_p1_h",
    "dis_vi_R_ohm", "dis_dSOC", "dis_dSOC_baseline", "temp_mean_C", "temp_max_C",
    "temp_thermal_slope", "temp_thermal_gain",
]
MISSION_FEATURES = [
    "chg_total_dur_s", "chg_cc_dur_s", "chg_cv_dur_s", "chg_energy_Wh", "chg_cv_energy_Wh",
    "chg_cv_fraction", "cv_setpoint_V", "chg_cv_mean_I_A_proxy", "chg_cum_Wh",
    "dis_total_dur_s", "dis_flight_Wh_abs", "dis_mean_C_rate_med", "dis_max_C_rate_p90",
    "dis_vi_R_ohm_med", "dis_vi_R_ohm_p90", "dis_dSOC_sum", "dis_dSOC_baseline_sum",
    "dis_cum_Wh", "temp_mean_C_med", "temp_max_C_max", "temp_th_gain_med",
    "temp_th_gain_max", "SOH_mission_end_pct", "RUL_med",
]

# ---- fixed values: features of the modelling tables ----
SOC_TABLE = ["duration_s", "energy_Wh", "mean_abs_power_W", "mean_temp_C", "max_temp_C",
             "mean_C_rate", "max_C_rate", "thermal_slope_K_per_s", "thermal_gain_K_per_W",
             "vi_slope_R_ohm", "ic_centroid_V", "ic_spread_V", "ic_peak1_V", "ic_peak1_height"]
SOH_TABLE = ["flight_Wh_abs", "dur_flight_s", "dur_charge_s", "dur_rest_s", "dur_transition_s",
             "eff_energy", "th_gain_med", "th_gain_max", "R_ohm_med", "R_ohm_p90",
             "ic_centroid_V", "ic_spread_V", "ic_p1_V", "ic_p1_h", "cv_fraction",
             "cc_fraction", "cv_mean_I_A_proxy"]
RUL_TABLE = ["thermal_gain_med", "mean_C", "max_C", "max_T", "vi_R", "ic_centroid_V",
             "flight_Wh", "charge_Wh"]
DSOH_FEATURES = ["flight_Wh_abs", "dur_cruise_s", "max_temp_C", "mean_C_rate", "max_C_rate",
                 "dur_cc_s", "dur_cv_s"]
BOX_FEATURES = ["duration_s", "energy_Wh", "delta_SOC", "thermal_slope_K_per_s",
                "thermal_gain_K_per_W"]
HISTOGRAM_FEATURES = ["dur_charge_s", "dur_rest_s", "dur_transition_s", "energy_charge_Wh",
                      "energy_rest_Wh", "energy_transition_Wh"]

# ---- fixed values: reporting order of models ----
MODEL_ORDER = ["rf", "xgb", "catboost", "lightgbm", "attn_lstm", "attn_lstm_moe"]

# ---- fixed values: thresholds and window lengths ----
EOL_PCT = 85.0
EOL_SWEEP = [80, 85, 90]
REST_CURRENT_MA = 50.0
VOLTAGE_LOW, VOLTAGE_HIGH = 2.5, 4.3
VOLTAGE_JUMP = 0.5
MIN_SEGMENT_S = 2.0
MIN_POWER_W = 1.0
IC_BINS = 60
IC_MIN_SAMPLES = 8
IC_MIN_RANGE_V = 0.05
VI_MIN_SAMPLES = 12
VI_MIN_STD_A = 0.05
CV_VOLTAGE_FEATURES = 4.19
CV_VOLTAGE_EXPLORATION = 4.10
CV_SETPOINTS = [4.00, 4.10, 4.20]
CV_SNAP_V = 0.05
SOC_STEPS = 16
MISSION_STEPS = 20
SOH_HORIZON = 5
CORR_LIMIT = 0.995
MIN_TRAIN_ROWS = 50
HISTOGRAM_BINS = 20
