"""Model baselines: importance, leave-one-cell-out forests and boosted trees, a parameter sweep.

Held-out models are grown for all cells at once, see ``grower``; a forest for importance is grown
a few trees to a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.functions import ordered
from voltarc.operators.grower import (Scale, Settings, code_matrix, coded, cut_points, held_out,
                                      importance_trees, shuffled_guesses)
from voltarc.operators.predictions import per_cell_metrics
from voltarc.sources.foldlog import FoldLog
from voltarc.sources.stages import settled

SEED = 1337
TREES_A_TASK = 12  # least trees of an importance forest that a task grows
TEST_BLOCK = 512  # test rows whose errors are added up together

#: The one default of library, queries and bench is the published budget: divisor of rounds, patience,
#: trees and least rows of the large-leaf preset, factor of the step.
SCALE = 1

# ---- fixed values: published budgets and tree settings of the models ----
PRESETS = {
    "xgb": Settings("xgb", 4000 // SCALE, step=0.03 * SCALE, depth=7, min_rows=5, l2=1.0, rows=0.9,
                    columns=0.9, patience=200 // SCALE, seed=SEED),
    "catboost": Settings("catboost", 5000 // SCALE, step=0.03 * SCALE, depth=8, l2=3.0, seed=SEED),
    "lightgbm": Settings("lightgbm", 5000 // SCALE, step=0.03 * SCALE, depth=63, leaves=63,
                         min_rows=200 // SCALE, l2=1.0, rows=0.9, columns=0.9, huber=0.9,
                         patience=200 // SCALE, seed=SEED),
}
FOREST = Settings("rf", 600 // SCALE, depth=12, min_rows=2, boost=False, seed=SEED)
#: A sweep compares its points on short runs, as the published one does.
SWEEP = replace(PRESETS["xgb"], trees=400, step=0.3, patience=20)


def hash_split(table: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """75 / 25 split by a hash of the key: the same rows whatever the partitioning."""
    part = F.pmod(F.xxhash64(*keys), F.lit(4))
    return table.where(part != 0), table.where(part == 0)


def _forest(table: DataFrame, keys: Sequence[str], trees: int, depth: int, repeats: int,
            min_rows: int = 50) -> tuple[list[str], DataFrame, DataFrame] | None:
    """Forest on the training part, ``TREES_A_TASK`` trees or more grown in a task; None under ``min_rows``
    rows. Returns the features, the impurity importance as ``(j, w)`` and the squared errors on the
    test part as ``(j, repeat, e, n, y, yy)``: j and repeat are -1 for the rows as they are, otherwise
    feature j has been shuffled. Trees and predictions stay in the tasks, sums leave them.

    A shuffle pairs the i-th test row with the i-th row of an order by a repeat-specific hash;
    rows are numbered by ranges, so no single task sorts the test part.
    """
    if table.limit(min_rows).count() < min_rows:
        return None
    features = [c for c in table.columns if c not in {*keys, "target"}]
    wide, bounds = len(features), cut_points(table, features)
    rows = settled(coded(table, features, "target", keys, bounds))
    scale = Scale.of(*(x or 0.0 for x in rows.agg(F.min("_y"), F.max("_y")).first()))
    train, test = hash_split(rows, keys)
    orders = test.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("repeat")
                         ).withColumn("_h", F.xxhash64("repeat", "_id", *keys))
    placed = ordered.with_position(
        ordered.range_blocks(orders, ["repeat", "_h", *keys]), ["repeat"], ["_h", *keys], "i")
    tests = settled(placed.groupBy("i").agg(
        F.max(F.when(F.col("repeat") == 0, F.struct("_y", "_codes"))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("repeat") > 0, F.struct("repeat", "_codes")))
                     ).alias("others")).select("i", "own.*", F.col("others._codes").alias("others")))
    own = Settings("importance", trees, depth=depth, boost=False, seed=42)
    # what leaves the tasks grows with their number: no more than can run at a time
    a_task = max(TREES_A_TASK, -(-trees // table.sparkSession.sparkContext.defaultParallelism))
    groups = -(-trees // a_task)

    def scored(g: int, base: float, made: list, rest: pd.DataFrame) -> pd.DataFrame:
        z = [code_matrix(pd.Series([o[r] for o in rest["others"]]), wide) for r in range(repeats)]
        guess = shuffled_guesses(base, made, code_matrix(rest["_codes"], wide), z)
        return pd.DataFrame({"_g": g, "i": rest["i"].astype("int64").astype("Int64"), "y": rest["_y"],
                             "guess": [x.tobytes() for x in guess], "gain": None})

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in the order of groups, training rows first: a row of shares of gain a group, then
        its predictions for the test rows as they come."""
        group, parts, forest = None, [], None

        def learned() -> tuple[tuple[float, list], pd.DataFrame]:
            codes, y, ids = [np.concatenate(x) for x in zip(*parts)]
            order = np.lexsort((y, ids))
            first = group * a_task
            base, made, gain = importance_trees(
                codes[order], y[order], ids[order].view(np.uint64), own, scale,
                range(first, min(first + a_task, trees)))
            return (base, made), pd.DataFrame({
                "_g": [group], "i": pd.array([None], "Int64"), "y": [None], "guess": [None],
                "gain": pd.Series([gain.tolist()], dtype=object)})

        for pdf in batches:
            for g, some in pdf.groupby("_g", sort=True):
                if g != group:
                    if parts and forest is None:
                        yield learned()[1]
                    group, parts, forest = int(g), [], None
                data, rest = some[~some["_test"]], some[some["_test"]]
                if len(data):
                    parts.append((code_matrix(data["_codes"], wide), data["_y"].to_numpy(),
                                  data["_id"].to_numpy()))
                if len(rest) and parts:
                    if forest is None:
                        forest, shares = learned()
                        yield shares
                    yield scored(group, *forest, rest)
        if parts and forest is None:
            yield learned()[1]

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "_g"])
        sums = np.frombuffer(b"".join(pdf["guess"]), float).reshape(-1, groups, 1 + wide * repeats)
        y = pdf["y"].to_numpy()[::groups]
        e = ((y[:, None] - sums.sum(axis=1) / trees)**2).sum(axis=0)
        j = np.r_[-1, np.repeat(np.arange(wide), repeats)]
        repeat = np.r_[-1, np.tile(np.arange(repeats), wide)]
        return pd.DataFrame({"j": j, "repeat": repeat, "e": e, "n": len(y), "y": y.sum(),
                             "yy": (y * y).sum()})

    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g")
    none = lambda kind: F.lit(None).cast(kind)
    left = train.select(each, F.lit(False).alias("_test"), none("long").alias("i"), "_y", "_id",
                        "_codes", none("array<binary>").alias("others"))
    right = tests.select(each, F.lit(True).alias("_test"), "i", "_y", F.lit(0).cast("long").alias("_id"),
                         "_codes", "others")
    dealt = left.unionByName(right).repartition(4 * groups, "_g")  # few groups share a partition
    done = settled(dealt.sortWithinPartitions("_g", "_test").mapInPandas(
        grown, "_g int, i long, y double, guess binary, gain array<double>"))
    gains = done.where("gain is not null").select(F.posexplode("gain").alias("j", "w")).groupBy(
        "j").agg(F.sum("w").alias("w"))
    blocks = done.where("i is not null").withColumn("_block", F.floor(F.col("i") / TEST_BLOCK))
    found = blocks.groupBy("_block").applyInPandas(
        errors, "j int, repeat int, e double, n long, y double, yy double").groupBy(
        "j", "repeat").agg(*[F.sum(c).alias(c) for c in ("e", "n", "y", "yy")])
    return features, gains, found


def feature_importance(table: DataFrame, keys: Sequence[str], name: str, trees: int = 300,
                       depth: int = 30) -> DataFrame:
    """Impurity importance per feature, highest first, with the R2 on the test part."""
    spark, kinds = table.sparkSession, "task string, feature string, gini_importance double, r2 double"
    forest = _forest(table, keys, trees, depth, 0)
    if not forest:
        return spark.createDataFrame([], kinds)
    features, gains, found = forest
    # a number per feature, and one row of sums
    weight, whole = {r["j"]: r["w"] for r in gains.collect()}, found.first()
    spread = whole["yy"] - whole["y"]**2 / whole["n"] if whole else 0.0
    r2 = 1 - whole["e"] / spread if spread > 0 else None
    total = sum(weight.values())
    return spark.createDataFrame(
        [(name, f, weight.get(j, 0.0) / total if total else 0.0, r2)
         for j, f in enumerate(features)], kinds).orderBy(F.desc("gini_importance"))


def permutation_importance(table: DataFrame, keys: Sequence[str], name: str, trees: int = 300,
                           depth: int = 30, repeats: int = 8) -> DataFrame:
    """Drop of R2 when one feature is shuffled: mean and deviation over ``repeats``."""
    forest = _forest(table, keys, trees, depth, repeats)
    if not forest:
        return table.sparkSession.createDataFrame(
            [], "task string, feature string, perm_importance_mean double, "
                "perm_importance_std double")
    features, _, found = forest
    found = settled(found)
    whole = found.where("j < 0").first()  # one row of sums
    spread = whole["yy"] - whole["y"]**2 / whole["n"] if whole else 0.0
    drop = F.try_divide(F.col("e") - F.lit(whole["e"] if whole else 0.0), F.lit(spread))
    labels = F.array(*[F.lit(f) for f in features])
    return found.where("j >= 0").groupBy("j").agg(
        F.avg(drop).alias("perm_importance_mean"),
        F.stddev_pop(drop).alias("perm_importance_std")
    ).select(F.lit(name).alias("task"), F.get(labels, F.col("j")).alias("feature"),
             "perm_importance_mean", "perm_importance_std").orderBy(
        F.desc("perm_importance_mean"))


def logged_predictions(log: FoldLog, samples: DataFrame, features: Sequence[str], label: str,
                       keys: Sequence[str], settings: Sequence[Settings], per_commit: int = 256,
                       **options) -> DataFrame:
    """:func:`grower.held_out` through a log: only held-out cells that the log does not hold are
    fitted, ``per_commit`` cells at a time, so a lost run costs the cells of one commit."""
    cells = [r[0] for r in samples.select("cell_id").distinct().collect()]  # one name per fold
    done = log.holds()
    left = sorted(set(cells) - (done or set()))
    for at in range(0, max(len(left), done is None), per_commit):  # without cells an empty commit
        own = left[at:at + per_commit]
        log.commit(held_out(samples, features, label, keys, settings,
                            holds=own if len(own) < len(cells) else None, **options), own)
    return log.table()


def grid_sweep(samples: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
               grid: Mapping[str, Sequence], base: Settings = SWEEP,
               cells: int | None = None) -> DataFrame:
    """One row per grid point: mean per-cell error over the held-out cells (all, or the first
    ``cells`` for a quick look). All points are grown in the same jobs."""
    first = None if cells is None else [r[0] for r in samples.select("cell_id").distinct()
                                        .orderBy("cell_id").limit(cells).collect()]
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    settings = [replace(base, name=str(i), **p) for i, p in enumerate(points)]
    guesses = held_out(samples, features, label, keys, settings, holds=first)
    found = per_cell_metrics(guesses, ["model"]).groupBy("model").agg(
        F.avg("MAE").alias("MAE_mean"), F.avg("RMSE").alias("RMSE_mean"),
        F.count(F.lit(1)).alias("cells"), F.sum("N").alias("N_total"))
    named = [F.element_at(F.array(*[F.lit(p[k]) for p in points]),
                          F.col("model").cast("int") + 1).alias(k) for k in grid]
    return found.select(*named, "MAE_mean", "RMSE_mean", "cells", "N_total")
