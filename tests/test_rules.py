"""Hand-worked tables for tie, missing-value and edge rules."""

import math

import pytest
from pyspark.sql import functions as F

from voltarc.operators import (cycles, exploration, folds, health, physics, predictions, segments,
                               sequences, tables)

SAMPLE = ("sample_id long, cell_id string, cycleNumber int, Ns int, time_s double, "
          "Ecell_V double, I_mA double, Temperature__C double, QDischarge_mA_h double, "
          "QCharge_mA_h double")


def samples(spark, rows, cell="VAH01", cycle=0):
    """Rows of (Ns, time, volts, mA[, charge])."""
    full = [(i, cell, cycle, r[0], float(r[1]), r[2], r[3], 20.0,
             r[4] if len(r) > 4 else 0.0, 0.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SAMPLE)


def cycle_rows(spark, rows):
    """Rows of (cycle, charge, is_test)."""
    return spark.createDataFrame(
        [("VAH01", c, float(q) if q is not None else None, t, p)
         for p, (c, q, t) in enumerate(rows)],
        "cell_id string, cycleNumber int, QDischarge_mAh double, is_capacity_test boolean, "
        "cycle_pos long")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_segments_break_at_missing_codes(spark):
    df = samples(spark, [(n, t, 3.5, 1.0) for t, n in enumerate([3, 3, None, None, 4])])
    assert column(segments.with_segments(df), "seg_id", "time_s") == [0, 0, 1, 2, 3]
    totals = segments.segment_totals(df)
    assert column(totals, "seg_id", "seg_id") == [0, 3]


def test_missing_first_code_starts_segment_one(spark):
    df = samples(spark, [(n, t, 3.5, 1.0) for t, n in enumerate([None, 2, 2])])
    assert column(segments.with_segments(df), "seg_id", "time_s") == [1, 2, 2]


def test_spacing_starts_at_zero_and_is_never_negative(spark):
    df = samples(spark, [(0, t, 3.5, 1.0) for t in (5, 7, 7, 12)])
    assert column(cycles.with_spacing(df), "dt", "time_s", "sample_id") == [0, 2, 0, 5]


def test_soh_between_before_and_after_tests(spark):
    rows = cycle_rows(spark, [(1, 9.0, False), (2, 10.0, True), (3, 1.0, False), (4, 1.0, False),
                              (5, 4.0, True), (6, 1.0, False)])
    got = health.with_soh(rows)
    assert column(got, "initial_capacity_mAh", "cycleNumber")[0] == 7.0
    want = [x / 7 * 100 for x in (10, 10, 8, 6, 4, 4)]
    assert column(got, "SOH_pct", "cycleNumber") == pytest.approx(want)


def test_soh_is_unknown_without_tests(spark):
    got = health.with_smoothed_soh(health.with_soh(cycle_rows(spark, [(1, 9.0, False)])))
    row = got.first()
    assert row["SOH_pct"] is None and row["SOH_pct_smoothed"] is None


def test_smoothing_is_a_trailing_median(spark):
    rows = cycle_rows(spark, [(i, q, True) for i, q in enumerate([100.0, 80, 90, 70, 60, 50])])
    got = health.with_smoothed_soh(rows.withColumn("SOH_pct", F.col("QDischarge_mAh")))
    assert column(got, "SOH_pct_smoothed", "cycleNumber") == [100, 90, 90, 85, 80, 70]


def test_rul_counts_down_to_the_first_crossing(spark):
    rows = cycle_rows(spark, [(i, 0.0, False) for i in range(5)]).withColumn(
        "mission_id", F.lit(None).cast("int"))
    crossing = rows.withColumn("SOH_pct_smoothed", F.lit(90.0) - F.col("cycleNumber") * 2)
    got = health.with_cycle_rul(crossing, health.end_of_life(crossing))
    assert column(got, "RUL_cycles", "cycleNumber") == [3, 2, 1, 0, 0]
    assert not any(column(got, "RUL_censored", "cycleNumber"))
    healthy = rows.withColumn("SOH_pct_smoothed", F.lit(100.0))
    got = health.with_cycle_rul(healthy, health.end_of_life(healthy))
    assert column(got, "RUL_cycles", "cycleNumber") == [4, 3, 2, 1, 0]
    assert all(column(got, "RUL_censored", "cycleNumber"))


def test_cycle_facts_rules(spark):
    df = samples(spark, [(5, 0, 3.0, 10.0), (2, 1, 4.0, -60.0), (2, 2, 3.9, 0.0),
                         (5, 3, 3.8, 0.0)])
    row = cycles.cycle_facts(df).first()
    assert row["Ns_mode"] == 2  # smallest of equally frequent codes
    assert row["max_jump_V"] == 1.0
    assert row["neg_dur_s"] == 1.0 and row["pos_dur_s"] == 0.0
    assert row["energy_discharge"] is None
    signs = spark.createDataFrame([("VAH01", -1)], "cell_id string, discharge_sign int")
    assert cycles.capacity_features(cycles.cycle_facts(df), signs).first()["quasi_cc"] is False
    assert cycles.cycle_facts(samples(spark, [(None, 0, 3.0, 1.0)])).first()["Ns_mode"] == -1


def test_discharge_sign_uses_cycle_borders_and_the_median_fallback(spark):
    def sign(df):
        placed = cycles.with_cycle_position(cycles.cycle_facts(df))
        return cycles.discharge_sign(placed, df).first()

    rising = samples(spark, [(5, t, 3.5, -1000.0, float(t)) for t in range(12)])
    got = sign(rising)
    assert (got["discharge_sign"], got["rising_rows"]) == (-1, 11)
    border = samples(spark, [(5, t, 3.5, 7.0, 50.0 + t) for t in range(12)], cycle=4)
    assert sign(rising.unionByName(border))["rising_rows"] == 23
    assert sign(samples(spark, [(5, t, 3.5, 9.0) for t in range(12)]))["discharge_sign"] == 1
    assert sign(samples(spark, [(5, t, 3.5, -9.0) for t in range(12)]))["discharge_sign"] == -1


def test_capacity_fallback_takes_two_cycles_without_flight(spark):
    rows = [("VAH01", c, s, q, f) for c, s, q, f in [
        (0, 2, 5.0, 0.0), (1, 2, 7.0, 0.0), (2, 1, 9.0, 0.0), (3, 2, 9.0, 0.5), (4, 2, 7.0, 0.0)]]
    scored = spark.createDataFrame(
        rows, "cell_id string, cycleNumber int, score int, QDischarge_mAh double, "
              "frac_flight double")
    flags = column(cycles.flag_capacity_tests(scored), "is_capacity_test", "cycleNumber")
    assert flags == [False, True, False, False, True]


def soc_cycle(spark, sign=1, soh=100.0, cap=1000.0):
    return spark.createDataFrame([("VAH01", 0, soh, cap, sign)],
                                 "cell_id string, cycleNumber int, SOH_pct double, "
                                 "initial_capacity_mAh double, discharge_sign int")


def test_soc_counts_from_full_and_clips_after_the_sum(spark):
    df = samples(spark, [(0, 0, 3.5, -500.0), (0, 3600, 3.5, -100.0), (5, 7200, 3.5, 300.0),
                         (5, 10800, 3.5, 2000.0)])
    got = column(health.with_soc(df, soc_cycle(spark)), "SOC", "time_s")
    assert got == pytest.approx([100.0, 100.0, 80.0, 0.0])
    unknown = health.with_soc(df, soc_cycle(spark, soh=None))
    assert column(unknown, "SOC", "time_s") == [None] * 4


def test_soc_is_unknown_after_a_missing_current(spark):
    df = samples(spark, [(5, 0, 3.5, 100.0), (5, 3600, 3.5, None), (5, 7200, 3.5, 100.0)])
    assert column(health.with_soc(df, soc_cycle(spark)), "SOC", "time_s") == [100.0, None, None]


def test_segment_soc_skips_missing_values(spark):
    df = samples(spark, [(5, t, 3.5, 1.0) for t in range(3)])
    soc = df.withColumn("SOC", F.when(F.col("time_s") > 0, F.col("time_s") + 6))
    row = segments.segment_totals(soc).first()
    assert (row["start_SOC"], row["end_SOC"]) == (7.0, 8.0)


def test_missions_are_numbered_over_take_off_and_landing(spark):
    parts = []
    for cycle, codes in enumerate([[4, 6], [4], [6, 4], [0]]):
        parts.append(samples(spark, [(n, t, 3.5, 1.0) for t, n in enumerate(codes)], cycle=cycle))
    df = parts[0]
    for other in parts[1:]:
        df = df.unionByName(other)
    got = cycles.with_cycle_position(cycles.cycle_facts(df))
    assert column(got, "mission_id", "cycleNumber") == [1, None, 2, None]
    assert column(got, "cycle_pos", "cycleNumber") == [0, 1, 2, 3]


def test_ic_bins_are_half_open_over_the_percentiles(spark):
    volts = [3.0 + 0.01 * i for i in range(101)]
    df = segments.with_segments(samples(spark, [(0, 60 * i, v, 100.0)
                                                for i, v in enumerate(volts)]))
    hist = physics.ic_histogram(df)
    row = hist.first()
    assert row["vmin"] == pytest.approx(3.02) and row["vmax"] == pytest.approx(3.98)
    counted = hist.agg(F.sum("charge_mAh")).first()[0]
    inside = [v for v in volts if row["vmin"] <= v < row["vmax"]]
    assert counted == pytest.approx(len(inside) * 100.0 / 60)
    feats = physics.ic_features(hist).first()
    assert 3.4 < feats["ic_centroid_V"] < 3.6 and feats["ic_spread_V"] > 0
    flat = segments.with_segments(samples(spark, [(0, i, 3.5, 100.0) for i in range(20)]))
    assert physics.ic_histogram(flat).count() == 0
    short = segments.with_segments(samples(spark, [(0, i, 3 + i / 10, 1.0) for i in range(7)]))
    assert physics.ic_histogram(short).count() == 0


def test_ic_second_peak_may_be_an_empty_bin(spark):
    hist = spark.createDataFrame([("VAH01", 0, 0, 10, 3.0, 3.6, -5.0)],
                                 "cell_id string, cycleNumber int, seg_id int, bin int, "
                                 "vmin double, vmax double, charge_mAh double")
    row = physics.ic_features(hist).first()
    assert row["ic_peak1_V"] == pytest.approx(3.105)
    assert row["ic_peak1_height"] == pytest.approx(-500.0)
    assert row["ic_peak2_V"] == pytest.approx(3.595) and row["ic_peak2_height"] == 0.0


def test_resistance_needs_samples_variation_and_no_gaps(spark):
    def fit(rows):
        return physics.vi_resistance(segments.with_segments(samples(spark, rows))).collect()

    line = [(5, t, 4.0 - 0.05 * t * 0.1, 100.0 * t) for t in range(12)]
    assert fit(line)[0]["vi_slope_R_ohm"] == pytest.approx(0.05)
    assert fit(line[:11]) == []
    assert fit([(5, t, 4.0, 5.0) for t in range(12)]) == []
    assert fit(line[:-1] + [(5, 11, None, 1100.0)]) == []


def test_thermal_gain_needs_one_watt(spark):
    df = spark.createDataFrame([(30.0, 20.0, 0.5, 2.0), (30.0, 20.0, 5.0, 0.9)],
                               "max_temp_C double, mean_temp_C double, duration_s double, "
                               "mean_abs_power_W double")
    a, b = physics.with_thermal(df).collect()
    assert (a["thermal_slope_K_per_s"], a["thermal_gain_K_per_W"]) == (10.0, 5.0)
    assert (b["thermal_slope_K_per_s"], b["thermal_gain_K_per_W"]) == (2.0, None)


def test_setpoint_snaps_to_known_levels(spark):
    def point(volts):
        df = samples(spark, [(1, i, volts, 1.0) for i in range(5)])
        return physics.cv_setpoint(df).first()["cv_setpoint_V"]

    assert [point(v) for v in (4.02, 4.12, 4.17, 3.456)] == [4.0, 4.1, 4.2, 3.46]


def test_histogram_counts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 19.9, 20)], "dur_rest_s double")
    got = exploration.mission_histograms(df, ["dur_rest_s"])
    counts = column(got, "n", "bin")
    assert len(counts) == 20 and counts[0] == 1 and counts[1] == 1 and counts[19] == 2
    same = spark.createDataFrame([(3.0,), (3.0,)], "dur_rest_s double")
    got = exploration.mission_histograms(same, ["dur_rest_s"])
    assert sum(column(got, "n", "bin")) == 2


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (5.0, 1.0, 5.0, 9.0, None)] + [("b", 2.0)],
                               "k string, x double")
    got = {(r["k"], r["x"]): r["r"] for r in
           exploration.average_ranks(df, ["k"], "x", "r").collect()}
    assert got == {("a", 1.0): 1.0, ("a", 5.0): 2.5, ("a", 9.0): 4.0, ("b", 2.0): 1.0}


def test_attention_of_length_one_has_no_entropy(spark):
    df = spark.createDataFrame([([1.0],), ([0.25] * 4,), ([],), ([0.1, 0.8, 0.1],)],
                               "attention array<double>")
    rows = predictions.attention_summary(df).collect()
    assert rows[0]["attn_entropy"] is None and rows[0]["attn_argmax"] == 0
    assert rows[1]["attn_entropy"] == pytest.approx(1.0, abs=1e-6)
    assert rows[2]["attn_entropy"] == 0.0 and rows[2]["attn_max"] is None
    assert rows[3]["attn_argmax"] == 1


def test_gate_takes_the_first_of_equal_weights(spark):
    df = spark.createDataFrame([([0.0, 2.0, 2.0],), ([3.0, 1.0, 0.0],)],
                               "gate_logits array<double>")
    a, b = predictions.gate_top2(df).collect()
    assert (a["gate_top1"], a["gate_top2"]) == (1, 2)
    total = sum(math.exp(x) for x in (3, 1, 0))
    assert b["gate_pi_top1"] == pytest.approx(math.exp(3) / total)


@pytest.mark.parametrize("given, want", [
    ((2, 5, 6), (13 / 3,) * 3), ((2, 5, 3), (3.5, 3.5, 3)), ((5, 1, 3), (5, 2, 2)),
    ((5, 4, 3), (5, 4, 3)), ((1, 9, 0), (5, 5, 0)), ((3, 3, 3), (3, 3, 3))])
def test_isotonic_fit(spark, given, want):
    df = spark.createDataFrame([tuple(map(float, given))], "p80 double, p85 double, p90 double")
    row = predictions.with_isotonic(df).first()
    assert (row["cal80"], row["cal85"], row["cal90"]) == pytest.approx(want)
    cascade = predictions.with_cascade(df).first()
    assert cascade["cas80"] >= cascade["cas85"] >= cascade["cas90"]


def test_isotonic_keeps_order_and_mean(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(400, 3))],
                               "p80 double, p85 double, p90 double")
    out = predictions.with_isotonic(df).toPandas()
    cal = out[["cal80", "cal85", "cal90"]].to_numpy()
    assert (np.diff(cal, axis=1) <= 1e-12).all()
    assert np.allclose(cal.mean(axis=1), out[["p80", "p85", "p90"]].to_numpy().mean(axis=1))
    assert predictions.isotonic_summary(predictions.with_isotonic(df)).first()["viol_after"] == 0


def test_rul_by_position_per_level(spark):
    df = spark.createDataFrame(
        [("VAH01", i + 1, i, s) for i, s in enumerate([95.0, 88.0, 84.0, 86.0])],
        "cell_id string, mission_id int, mission_pos long, SOH_end_pct double")
    got = sequences.rul_missions(df)
    by = {level: column(got.where(F.col("eol") == level), "RUL_missions", "mission_id")
          for level in (80, 85, 90)}
    assert by == {80: [3, 2, 1, 0], 85: [2, 1, 0, 0], 90: [1, 0, 0, 0]}


def test_padding_and_mask(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], 2)],
                               "steps array<array<double>>, length int")
    row = sequences.padded(df, 4).first()
    assert row["padded"] == [[1, 2], [3, 4], [0, 0], [0, 0]]
    assert row["mask"] == [True, True, False, False]


def test_window_scaler_weighs_overlaps(spark):
    import numpy as np
    xs = [1.0, 5.0, 2.0, 8.0, 3.0]
    df = spark.createDataFrame([("VAH01", i, x, 7.0) for i, x in enumerate(xs)],
                               "cell_id string, pos long, x double, c double")
    for first in (0, 1):
        got = {r["feature"]: r for r in sequences.window_scaler(
            df, ["x", "c"], ["cell_id"], "pos", 3, first).collect()}
        stack = np.concatenate([xs[max(0, t - 2):t + 1] for t in range(first, 5)])
        assert got["x"]["n_steps"] == len(stack)
        assert got["x"]["mean"] == pytest.approx(stack.mean())
        assert got["x"]["std"] == pytest.approx(stack.std())
        assert got["c"]["std"] == 1.0


def test_leakage_names_are_substring_matches(spark):
    names = ["energy_Wh", "voltage_max", "RUL_x", "cycle_n", "dur_s", "mission_id"]
    df = spark.createDataFrame([(n,) for n in names], "feature string")
    kept = [r["feature"] for r in tables.leakage_name_guard(df).where("kept").collect()]
    assert kept == tables.safe_names(names) == ["energy_Wh", "dur_s"]


def test_one_hot_gives_zeros_for_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    rows = tables.one_hot(df, ["p"]).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 1), (0, 0)]
    many = spark.range(1200).select(F.col("id").cast("string").alias("p"))
    assert len(tables.categories(many, "p")) == 1200
    listed = tables.one_hot(df, ["p"], values={"p": ["b", "c"]})
    assert listed.columns == ["p_b", "p_c"] and [tuple(r) for r in listed.collect()] == [
        (0, 0), (1, 0), (0, 0)]


def test_folds_are_disjoint_complete_and_balanced(spark):
    sizes = {"a": 50, "b": 30, "c": 30, "d": 10, "e": 5}
    df = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)],
                               "cell_id string")
    roles = folds.fold_roles(df).collect()
    for hold in sizes:
        mine = {r["cell_id"]: r for r in roles if r["hold"] == hold}
        assert set(mine) == set(sizes) and mine[hold]["role"] == "test"
    held_e = {r["cell_id"]: r["fold"] for r in roles if r["hold"] == "e"}
    assert held_e == {"a": 0, "c": 1, "b": 2, "d": 2, "e": None} or held_e["d"] in (1, 2)
    runs = {r["hold"]: r for r in folds.loco_folds(df, min_train=80).collect()}
    assert runs["a"]["n_train"] == 75 and not runs["a"]["is_run"] and runs["b"]["is_run"]


def test_folds_have_no_cell_limit(spark):
    df = spark.range(2200).select(F.concat(F.lit("c"), F.col("id") % 1100).alias("cell_id"))
    got = folds.loco_folds(df).collect()
    assert len(got) == 1100 and {(r["n_test"], r["n_train"]) for r in got} == {(2, 2198)}


def test_roles_of_many_cells(spark):
    """Folds resumed from a shared state equal a deal from the start."""
    df = spark.range(6000).select(F.concat(F.lit("c"), F.col("id") % 1100).alias("cell_id"))
    sizes = {r[0]: r[1] for r in df.groupBy("cell_id").count().collect()}
    roles = folds.fold_roles(df)
    assert "Window" not in roles._jdf.queryExecution().toString()
    assert roles.count() == len(sizes) ** 2
    some = sorted(sizes)[::60]
    got = {(r["hold"], r["cell_id"]): (r["n"], r["fold"], r["role"])
           for r in roles.where(F.col("hold").isin(some)).collect()}
    for hold in some:
        loads = [0, 0, 0]
        for n, c in sorted(((n, c) for c, n in sizes.items() if c != hold), reverse=True):
            part = loads.index(min(loads))
            loads[part] += n
            assert got[hold, c] == (n, part, "val" if part == 0 else "train")
        assert got[hold, hold] == (sizes[hold], None, "test")


@pytest.mark.parametrize("few,blocks", [(256, 64), (3, 8)])
def test_quantiles_of_unions_of_cells(spark, few, blocks):
    import numpy as np
    from voltarc.functions.subsets import subset_quantiles
    rng = np.random.default_rng(few)
    rows = [(f"c{rng.integers(0, 6)}", g, float(x)) for g, draw in (
        ("ties", lambda: rng.integers(0, 3)), ("zero", lambda: max(0, rng.normal())),
        ("plain", lambda: rng.normal())) for x in [draw() for _ in range(300)]]
    rows += [("c1", "plain", None), ("c2", "plain", float("nan")), ("c1", "one", 4.0),
             ("c0", "none", None), ("c9", "big", 1e300), ("c8", "big", -1e300)]
    members = [(u, f"c{c}") for u, own in {"a": range(6), "b": [0, 5], "d": [1], "e": [8, 9],
                                           "f": []}.items() for c in own]
    for prob in (0.5, 0.9):
        got = {(r["u"], r["g"]): r["quantile"] for r in subset_quantiles(
            spark.createDataFrame(rows, "cell string, g string, x double"), ["g"], "cell", "x",
            spark.createDataFrame(members, "u string, cell string"), "u", prob, blocks, few
        ).collect()}
        want = {}
        for u in "abde":
            own = {c for v, c in members if v == u}
            for g in {r[1] for r in rows}:
                x = [r[2] for r in rows if r[0] in own and r[1] == g
                     and r[2] is not None and r[2] == r[2]]
                if x:
                    want[u, g] = np.quantile(x, prob)
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v)


def test_roles_of_chosen_folds(spark):
    df = spark.range(60).select(F.concat(F.lit("c"), F.col("id") % 30).alias("cell_id"))
    roles = folds.fold_roles(df, holds=["c7"]).collect()
    assert len(roles) == 30 and [r["cell_id"] for r in roles if r["role"] == "test"] == ["c7"]


def test_fold_statistics_equal_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"cell_id": rng.choice(list("abcd"), 200), "x": rng.normal(5, 2, 200),
                          "k": 3.0})
    frame["y"] = frame.x * 2 + rng.normal(size=200)
    frame.loc[::9, "x"] = np.nan
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
            for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "cell_id string, x double, k double, y double")
    roles = folds.fold_roles(df)
    plan = {(r["hold"], r["feature"]): r
            for r in folds.fold_prepare(df, ["x", "k"], "y", 0.5).collect()}
    train = {}
    for r in roles.where("role = 'train'").collect():
        train.setdefault(r["hold"], []).append(r["cell_id"])
    for hold, cells in train.items():
        part = frame[frame.cell_id.isin(cells)]
        row = plan[(hold, "x")]
        filled = part.x.fillna(part.x.median())
        assert row["corr"] == pytest.approx(part.x.corr(part.y))
        assert row["fill"] == pytest.approx(part.x.median())
        assert row["center"] == pytest.approx(filled.mean())
        assert row["scale"] == pytest.approx(filled.std(ddof=0))
        assert row["kept"] is False
        flat = plan[(hold, "k")]
        assert flat["corr"] is None and flat["kept"] and flat["scale"] == 1.0
