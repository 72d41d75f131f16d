"""Model operators on a small table with a known signal."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltarc.operators import folds, grower, models, predictions
from voltarc.operators.grower import held_out
from voltarc.sources.foldlog import FoldLog


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for cell in ("VAH01", "VAH02", "VAH03", "VAH04"):
        for mission in range(1, 41):
            a, b = rng.normal(size=2)
            rows.append((cell, mission, float(a), float(b), float(3 * a + b)))
    return spark.createDataFrame(
        rows, "cell_id string, mission_id int, signal double, noise double, y double").cache()


KEYS = ["cell_id", "mission_id"]


def errors(df):
    return df.agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0]


def test_forest_beats_the_mean(table):
    got = held_out(table, ["signal", "noise"], "y", KEYS,
                   [replace(models.FOREST, trees=10, depth=5)])
    assert got.columns[:2] == KEYS and got.count() == table.count()
    mean = table.agg(F.avg("y")).first()[0]
    assert errors(got) < 0.6 * table.agg(F.avg(F.abs(F.col("y") - mean))).first()[0]
    assert predictions.per_cell_metrics(got).count() == 4


def test_patience():
    flat = [5, 4, 4, 6, 4, 3, 7, 7, 2]
    for patience, rounds in ((1, 2), (3, 2), (4, 9), (None, 9)):
        wait = grower.Patience(patience)
        for e in flat:
            if not wait.goes_on(e):
                break
        assert wait.rounds == rounds
    wait = grower.Patience(2)  # without validation rows all rounds stay
    assert all(wait.goes_on(None) for _ in range(9)) and wait.rounds == 9


def plain_tree(codes, y, rows, settings, allowed):
    """A regression tree the slow way: node -> (rows, feature, cut) by trying every cut."""
    def score(g):
        return g.sum()**2 / (len(g) + settings.l2)

    def best(own):
        top = (1e-9, None)
        for f in allowed:
            for c in sorted(set(codes[own, f]))[:-1]:
                left, right = own[codes[own, f] <= c], own[codes[own, f] > c]
                if min(len(left), len(right)) >= settings.min_rows:
                    gain = score(y[left]) + score(y[right]) - score(y[own])
                    if gain > top[0] * (1 + 1e-12):
                        top = (gain, (f, c, left, right))
        return top

    leaves, queue = [], [(best(rows), rows, 0)]
    splits = 0
    while queue:
        queue.sort(key=lambda q: -q[0][0])
        (gain, split), own, depth = queue.pop(0)
        full = settings.leaves is not None and splits >= settings.leaves - 1
        if split is None or depth >= settings.depth or full:
            leaves.append(own)
            continue
        splits += 1
        queue += [(best(split[2]), split[2], depth + 1), (best(split[3]), split[3], depth + 1)]
    return leaves


@pytest.mark.parametrize("changes", [{}, {"leaves": 6, "depth": 30}, {"l2": 4.0, "min_rows": 9},
                                     {"columns": 0.5}])
def test_boosting_equals_a_plain_grower(changes):
    """Rounds of squared-loss boosting on one fold, against trying every cut of every node."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 12, (120, 4)).astype(np.uint8)
    y = codes @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=120)
    own = replace(models.PRESETS["xgb"], **{"trees": 4, "depth": 3, "rows": 1.0, "columns": 1.0,
                                            "min_rows": 3, **changes})
    train, check = np.arange(90), np.arange(90, 120)
    scale = grower.Scale.of(y.min(), y.max())
    base, trees = grower.fit(codes, y, np.arange(120, dtype=np.uint64), train, check,
                             np.ones(4, bool), own, scale)
    got = grower.predict(base, trees, codes, own)
    guess, kept = np.full(120, y[train].mean()), []
    for t in range(4):
        allowed = np.flatnonzero(grower.columns(np.ones(4, bool), own, t))
        step = np.zeros(120)
        for leaf in plain_tree(codes, guess - y, train, own, allowed):
            # rows outside the training set that the same cuts lead here share its value
            value = -own.step * (guess - y)[leaf].sum() / (len(leaf) + own.l2)
            same = grower.walk(trees[t], codes) if t < len(trees) else None
            if same is None:
                break
            assert len(set(same[leaf])) == 1
            step[same == same[leaf[0]]] = value
        guess = guess + step
        kept.append(guess)
    assert np.allclose(got, kept[len(trees) - 1], atol=1e-5)


def test_rows_that_stay_grow_the_same_trees(table):
    """Models grown over rows that stay where they are equal those grown in one task."""
    settings = [replace(models.FOREST, trees=5, depth=4),
                replace(models.PRESETS["xgb"], trees=4, depth=3, patience=2),
                replace(models.PRESETS["lightgbm"], trees=4, leaves=5, min_rows=4, patience=1)]
    names = ["signal", "noise", "hole"]
    rows = table.withColumn("hole", F.when(F.col("mission_id") % 7 != 0, F.col("noise") * 2))
    args = (rows, names, "y", KEYS, settings)
    one = held_out(*args, fill_missing=True, holds=["VAH01", "VAH03"])
    two = held_out(*args, fill_missing=True, holds=["VAH01", "VAH03"], local_cells=0)
    key = lambda r: (r.model, r.cell_id, r.mission_id)
    a, b = sorted(one.collect(), key=key), sorted(two.collect(), key=key)
    assert len(a) == 2 * 3 * 40
    assert [(key(r), r.rounds) for r in a] == [(key(r), r.rounds) for r in b]
    assert [r.y_pred for r in a] == pytest.approx([r.y_pred for r in b], abs=1e-9)


def test_held_rows_grow_the_same_trees(spark, table, monkeypatch):
    """Models too large for a group, but not for their codes, are not spread; rows come in batches."""
    settings = [replace(models.FOREST, trees=5, depth=4),
                replace(models.PRESETS["lightgbm"], trees=4, leaves=5, min_rows=4, patience=1)]
    args = (table, ["signal", "noise"], "y", KEYS, settings)
    key = lambda r: (r.model, r.cell_id, r.mission_id)
    one = sorted(held_out(*args).collect(), key=key)
    monkeypatch.setattr(grower, "_spread", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        two = sorted(held_out(*args, local_cells=100).collect(), key=key)  # 160 x 2 cells
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(one) == 2 * 160
    assert [(key(r), r.rounds, r.y_true) for r in one] == [(key(r), r.rounds, r.y_true) for r in two]
    assert [r.y_pred for r in one] == pytest.approx([r.y_pred for r in two], abs=1e-12)


@pytest.mark.parametrize("changes", [{}, {"leaves": 7, "depth": 30}, {"rows": 0.8, "columns": 0.5},
                                     {"boost": False, "min_rows": 2}])
def test_histograms_count_the_smaller_child(changes, monkeypatch):
    """Below the root at most half of the rows are counted, none in nodes that cannot split; the
    trees are those of sums over cells, also where these are made for few nodes at a time."""
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 40, (3000, 5)).astype(np.uint8)
    codes[:, 2] = 7  # one code: nothing to split
    y = codes @ np.array([1.0, -2.0, 0.0, 0.5, 0.0]) + rng.normal(size=3000)
    own = replace(models.PRESETS["xgb"], **{"trees": 3, "depth": 5, "rows": 1.0, "columns": 1.0,
                                            "patience": None, **changes})
    args = (codes, y, np.arange(3000, dtype=np.uint64), np.arange(2500), np.arange(2500, 3000),
            np.ones(5, bool), own, grower.Scale.of(y.min(), y.max()))
    counted, sums = [], grower.Histograms.sums
    monkeypatch.setattr(grower.Histograms, "sums", lambda self, slot, *rest: (
        counted.append(len(slot)), sums(self, slot, *rest))[1])
    _, trees = grower.fit(*args)
    if own.leaves is None and own.boost and own.rows == 1:
        assert len(counted) == 3 * 5  # the last level's nodes do not split
        assert all(n <= (2500 if k % 5 == 0 else 1250) for k, n in enumerate(counted))
    monkeypatch.setattr(grower, "DENSE_CELLS", 0)
    searched, search = [], grower.best_splits
    monkeypatch.setattr(grower, "SPARSE_CELLS", 2000)
    monkeypatch.setattr(grower, "best_splits", lambda found, *rest: (
        searched.append(len(found[0])), search(found, *rest))[1])
    counted.clear()
    _, plain = grower.fit(*args)
    assert not counted and len(searched) > 3 * 5 and len(plain) == len(trees)
    for a, b in zip(trees, plain):
        on = a["left"] >= 0
        assert (a["left"] == b["left"]).all() and (a["value"] == b["value"]).all()
        assert all((a[k][on] == b[k][on]).all() for k in ("feature", "cut"))


def test_codes():
    bounds = np.array([1.0, 2.0, 5.0])
    assert grower.code_of(np.array([0.5, 1.0, 1.5, 2.0, 5.0, 6.0, np.nan]), bounds).tolist() == [
        0, 0, 1, 1, 2, 3, 255]


def test_folds_without_rows(spark, table):
    few = [replace(models.FOREST, trees=2)]
    assert held_out(table.limit(0), ["signal"], "y", KEYS, few).count() == 0
    assert held_out(table, ["signal"], "y", KEYS, few, min_train=10**6).count() == 0
    alone = table.where("cell_id = 'VAH01'")
    assert held_out(alone, ["signal"], "y", KEYS, few).count() == 0


def test_log_resumes(spark, table, tmp_path, monkeypatch):
    """A second run fits only the cells that the first has not committed."""
    fitted = []

    def spy(*args, **options):
        fitted.append(options["holds"])
        if len(fitted) == 2:
            raise RuntimeError("lost")
        return held_out(*args, **options)

    monkeypatch.setattr(models, "held_out", spy)
    run = lambda: models.logged_predictions(
        FoldLog(spark, str(tmp_path / "log")), table, ["signal"], "y", KEYS,
        [replace(models.FOREST, trees=2)], per_commit=2)
    with pytest.raises(RuntimeError):
        run()
    got = run()
    assert fitted == [["VAH01", "VAH02"], ["VAH03", "VAH04"], ["VAH03", "VAH04"]]
    assert got.count() == 160 and got.select(*KEYS).distinct().count() == 160
    assert run().count() == 160 and len(fitted) == 3


def test_guard_drops_a_copy_of_the_label(table):
    leaky = table.withColumn("copy", F.col("y"))
    plan = folds.fold_prepare(leaky, ["signal", "copy"], "y", 0.9999).collect()
    assert {r["feature"] for r in plan if not r["kept"]} == {"copy"}


def test_importance_finds_the_signal(table):
    data = table.select(*KEYS, "signal", "noise", F.col("y").alias("target"))
    gini = models.feature_importance(data, KEYS, "t", trees=10, depth=5).collect()
    assert gini[0]["feature"] == "signal" and gini[0]["r2"] > 0.5
    perm = models.permutation_importance(data, KEYS, "t", trees=10, depth=5, repeats=3).collect()
    assert perm[0]["feature"] == "signal" and perm[0]["perm_importance_mean"] > 0.5
    few = data.limit(20)
    assert models.feature_importance(few, KEYS, "t").count() == 0
    assert models.permutation_importance(few, KEYS, "t").count() == 0


def test_importance_equals_one_forest_in_one_place(table, monkeypatch):
    """Trees grown a few to a task, whose sums alone leave it, against all trees on collected rows."""
    monkeypatch.setattr(models, "TREES_A_TASK", 3)
    monkeypatch.setattr(models, "TEST_BLOCK", 7)
    names = ["signal", "noise", "flat"]
    data = table.select(*KEYS, "signal", "noise", F.lit(1.5).alias("flat"), F.col("y").alias("target"))
    rows = [r.asDict() for r in data.withColumn("id", F.xxhash64(*KEYS)).collect()]
    bounds = grower.cut_points(data, names)
    code = lambda some: np.column_stack([
        grower.code_of(np.array([r[f] for r in some]), b) for f, b in zip(names, bounds)])
    ys = [r["target"] for r in rows]
    train = sorted((r for r in rows if r["id"] % 4), key=lambda r: r["id"])
    test = [r for r in rows if r["id"] % 4 == 0]
    own = grower.Settings("importance", 8, depth=6, boost=False, seed=42)
    base, trees, gain = grower.importance_trees(
        code(train), np.array([r["target"] for r in train]),
        np.array([r["id"] for r in train]).view(np.uint64), own,
        grower.Scale.of(min(ys), max(ys)), range(8))
    guess = lambda some: grower.predict(base, trees, some, own)
    y = np.array([r["target"] for r in test])
    plain = ((y - guess(code(test)))**2).sum()
    spread = ((y - y.mean())**2).sum()
    gini = {r.feature: r for r in models.feature_importance(data, KEYS, "t", 8, 6).collect()}
    assert [gini[f].gini_importance for f in names] == pytest.approx(list(gain / gain.sum()))
    assert gini["signal"].r2 == pytest.approx(1 - plain / spread) and len(trees) == 8

    orders = data.withColumn("id", F.xxhash64(*KEYS)).where("pmod(id, 4) = 0").select(
        "*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("repeat")).withColumn(
        "h", F.xxhash64("repeat", "id", *KEYS)).collect()
    order = [[r.asDict() for r in sorted(orders, key=lambda r: r.h) if r.repeat == k] for k in (0, 1, 2)]
    y = np.array([r["target"] for r in order[0]])
    perm = {r.feature: r for r in models.permutation_importance(data, KEYS, "t", 8, 6, 2).collect()}
    for j, f in enumerate(names):
        drops = []
        for donors in order[1:]:
            x = code(order[0])
            x[:, j] = code(donors)[:, j]
            drops.append((((y - guess(x))**2).sum() - plain) / spread)
        assert perm[f].perm_importance_mean == pytest.approx(np.mean(drops), abs=1e-9)
        assert perm[f].perm_importance_std == pytest.approx(np.std(drops), abs=1e-9)
    assert perm["flat"].perm_importance_mean == 0


def test_shuffled_features_are_walked_where_they_matter(monkeypatch):
    """Predictions with one feature shuffled equal those of whole rows; a tree is walked again only
    for rows whose path tests the feature."""
    rng = np.random.default_rng(6)
    codes, others = (rng.integers(0, 30, (400, 70)).astype(np.uint8) for _ in range(2))
    others = [others, others[::-1]]
    y = codes[:, 0] + 0.3 * codes[:, 69] + rng.normal(size=400)
    own = grower.Settings("importance", 5, depth=12, boost=False, seed=42)
    base, trees, _ = grower.importance_trees(
        codes, y, np.arange(400, dtype=np.uint64), own, grower.Scale.of(y.min(), y.max()), range(5))
    walked, walk = [], grower.walk_changed
    monkeypatch.setattr(grower, "walk_changed", lambda tree, c, rows, *rest: (
        walked.append(len(rows)), walk(tree, c, rows, *rest))[1])
    got = grower.shuffled_guesses(base, trees, codes, others)
    assert got.shape == (400, 1 + 70 * 2)
    assert np.allclose(got[:, 0] / 5, grower.predict(base, trees, codes, own))
    for j in range(70):
        for r, z in enumerate(others):
            x = codes.copy()
            x[:, j] = z[:, j]
            assert np.allclose(got[:, 1 + 2 * j + r] / 5, grower.predict(base, trees, x, own))
    assert sum(walked) < 0.25 * 400 * 70 * 2 * 5


def test_every_model_meets_every_task(spark, monkeypatch):
    """Boosters and pooled sequences too get SOC, SOH and all three levels, each with features and
    with the library's settings."""
    from voltarc.plans import catalog
    from voltarc.plans.pipeline import Pipeline

    runs = []

    def fake(samples, features, label, keys, settings, **options):
        runs.append((tuple(settings), label, len(features)))
        assert set(features) <= set(samples.columns)
        return samples.select(*keys, F.col(label).cast("double").alias("y_true"),
                              F.lit(0.0).alias("y_pred"), F.lit(settings[0].name).alias("model"),
                              F.lit(0).alias("rounds"), F.lit(0.0).alias("predict_ms"))

    monkeypatch.setattr(models, "held_out", fake)
    p = Pipeline.from_tables(spark, "/root/testdata/sf0.001")
    tasks = {"soc_phase_delta", "soh_next", "rul_eol_80", "rul_eol_85", "rul_eol_90"}
    labels = sorted(["label", "dSOH_to_future"] + 3 * ["RUL_missions"])
    usual = {"loco_rf": (models.FOREST,), "loco_gbt": tuple(models.PRESETS.values()),
             "loco_seq": (replace(models.FOREST, name="pooled_rf"),)}
    for name, settings in usual.items():
        runs.clear()
        got = catalog.QUERIES[name].spark(p)
        assert sorted(y for _, y, _ in runs) == labels
        assert all(s == settings and k for s, _, k in runs)
        assert {r.task for r in got.select("task").distinct().collect()} <= tasks
    runs.clear()
    assert catalog.QUERIES["loco_eval"].spark(p).count() > 0 and not runs  # from the log
    assert catalog.QUERIES["grid_sweep"].spark(p).count() > 0
    assert len(runs) == 3 and all(len(s) == 4 for s, _, _ in runs)


def test_budgets_are_scaled_together():
    s = models.SCALE
    assert [(p.trees * s, round(p.step / s, 9)) for p in models.PRESETS.values()] == [
        (4000, 0.03), (5000, 0.03), (5000, 0.03)]
    assert models.PRESETS["xgb"].patience * s == 200 and models.FOREST.trees * s == 600


def test_queries_fit_the_published_budgets():
    """Held-out models get all rounds, trees and patience; a round's step is the published one."""
    from voltarc.plans import catalog

    assert [(s.trees, s.step, s.patience) for s in catalog.GROUPS["gbt"]] == [
        (4000, 0.03, 200), (5000, 0.03, None), (5000, 0.03, 200)]
    assert catalog.GROUPS["gbt"][2].min_rows == 200
    assert [s.trees for g in ("rf", "seq") for s in catalog.GROUPS[g]] == [600, 600]


@pytest.mark.parametrize("flat", [0, 1 << 20])
def test_histograms_hold_codes_that_occur(flat, monkeypatch):
    """Codes that no counted row has take no place, whichever way sums are made; cuts stay the same."""
    monkeypatch.setattr(grower, "FLAT_CELLS", flat)
    rng = np.random.default_rng(3)
    codes = rng.choice([3, 90, 200, 250], (60, 3)).astype(np.uint8)
    codes[40:, 0] = 120  # not among the counted rows
    gradient, weight = rng.integers(-9, 9, 60), rng.integers(1, 3, 40)
    tables = grower.Histograms(codes, np.array([True, True, False]), np.arange(40))
    assert tables.width == 8 and set(tables.code.tolist()) == {3, 90, 200, 250}
    slot = rng.integers(0, 2, 40)
    n, g = tables.sums(slot, np.arange(40), weight, gradient, 2)
    for s in range(2):
        for f, c, rows, pull in zip(tables.feature, tables.code, n[s], g[s]):
            own = (slot == s) & (codes[:40, f] == c)
            assert rows == weight[own].sum() and pull == (weight * gradient[:40])[own].sum()


def test_segment_pools(spark):
    rows = spark.createDataFrame(
        [("VAH01", 1, 3, s, float(x)) for s, x in enumerate([1, 5, 3, 8])]
        + [("VAH01", 2, 4, 0, 7.0)],
        "cell_id string, mission_id int, cycleNumber int, seg_id int, a double")
    from voltarc.operators import sequences
    got = {(r.mission_id, r.seg_id): r for r in
           sequences.pooled_segments(rows, ["a"], steps=3).collect()}
    assert len(got) == 5
    assert [got[1, 3][f"a__{k}"] for k in ("last", "mean", "min", "max", "slope")] == \
        pytest.approx([8, 16 / 3, 3, 8, 1.5])
    assert got[2, 0]["a__slope"] == 0 and got[2, 0]["a__mean"] == 7
