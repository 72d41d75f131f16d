"""Leave-one-cell-out folds, the inner validation split, and per-fold guards and scaling.

Fold statistics come from one row per (cell, feature) with count, mean and variances; a fold
combines the rows of its training cells, so the samples are read once and not once per fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltarc.functions import fixed
from voltarc.functions.subsets import subset_quantiles
from voltarc.operators.tables import quoted
from voltarc.sources.stages import settled

ROLES_PER_TASK = 50_000  # roles that a dealing task makes, about


def cell_sizes(samples: DataFrame) -> DataFrame:
    """Samples per cell."""
    return samples.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def loco_folds(samples: DataFrame, min_train: int = fixed.MIN_TRAIN_ROWS) -> DataFrame:
    """One fold per cell: its own samples test, all others train; ``is_run`` is the skip rule."""
    sizes = settled(cell_sizes(samples))
    total = sizes.agg(F.sum("n")).first()[0] or 0  # one number
    return sizes.select(
        F.col("cell_id").alias("hold"), F.col("n").alias("n_test"),
        (F.lit(total).cast("long") - F.col("n")).alias("n_train")
    ).withColumn("is_run", (F.col("n_test") > 0) & (F.col("n_train") >= min_train))


def fold_roles(samples: DataFrame, holds: Sequence[str] | None = None) -> DataFrame:
    """``(hold, cell_id, n, fold, role)``: role of every cell in every fold.

    Training cells are dealt by size, largest first (ties: later cell id first), to the lightest
    of 2 or 3 parts; the first part is the validation set. ``holds`` names the cells to hold out,
    by default all. Every fold is dealt in a task of its own, from the state that the deal of all
    cells had before the held-out one, which the fold shares with it. The driver reads the list of
    cells, a name and a number each, as it does to name the folds.
    """
    sizes = settled(cell_sizes(samples))
    cells = sorted(((r["n"], r["cell_id"]) for r in sizes.where("cell_id is not null").collect()),
                   reverse=True)
    parts = min(3, max(2, len(cells) - 1))
    loads, states, first = [0] * parts, [], []
    for n, _ in cells:
        states.append(tuple(loads))
        first.append(loads.index(min(loads)))
        loads[first[-1]] += n
    place = {c: i for i, (_, c) in enumerate(cells)}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for hold in pdf["cell_id"]:
                at = place[hold]
                own, load = first[:at], list(states[at])
                for n, _ in cells[at + 1:]:
                    own.append(load.index(min(load)))
                    load[own[-1]] += n
                rest = cells[:at] + cells[at + 1:]
                yield pd.DataFrame({
                    "hold": hold, "cell_id": [c for _, c in rest] + [hold],
                    "n": [n for n, _ in rest] + [cells[at][0]],
                    "fold": pd.array(own + [None], "Int32"),
                    "role": ["val" if f == 0 else "train" for f in own] + ["test"]})

    chosen = sizes.select("cell_id").where("cell_id is not null")
    if holds is not None:
        chosen = chosen.where(F.col("cell_id").isin(list(holds)))
    tasks = max(1, len(cells) * len(cells) // ROLES_PER_TASK)
    return chosen.repartition(tasks, "cell_id").mapInPandas(
        deal, "hold string, cell_id string, n long, fold int, role string")


def long_features(samples: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    return samples.select("cell_id", F.col(label).cast("double").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), quoted(f).cast("double").alias("x"))
        for f in features])).alias("_p")).select("cell_id", "y", "_p.*")


def cell_statistics(samples: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Counts, means, variances and covariance per (cell, feature); pairs need both values."""
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    px, py = F.when(pair, F.col("x")), F.when(pair, F.col("y"))
    return long_features(samples, features, label).groupBy("cell_id", "feature").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"),
        F.avg("x").alias("m"), F.var_pop("x").alias("v"),
        F.count(px).alias("np"), F.avg(px).alias("mx"), F.avg(py).alias("my"),
        F.var_pop(px).alias("vx"), F.var_pop(py).alias("vy"),
        F.covar_pop(px, py).alias("cxy"),
        F.min(px).alias("lox"), F.max(px).alias("hix"),
        F.min(py).alias("loy"), F.max(py).alias("hiy"))


def fold_statistics(statistics: DataFrame, roles: DataFrame) -> DataFrame:
    """Training-cell statistics combined per (hold, feature): count, mean, deviation, corr."""
    train = roles.where(F.col("role") == "train").select("hold", "cell_id")
    rows = statistics.join(train, "cell_id")
    fold = Window.partitionBy("hold", "feature")  # one row per training cell


    rows = rows.withColumns({"_m": F.try_divide(F.sum(F.col("m") * F.col("n")).over(fold),
                                                F.sum("n").over(fold)),
                             "_mx": F.try_divide(F.sum(F.col("mx") * F.col("np")).over(fold),
                                                 F.sum("np").over(fold)),
                             "_my": F.try_divide(F.sum(F.col("my") * F.col("np")).over(fold),
                                                 F.sum("np").over(fold))})
    dx, dy, dm = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my"), F.col("m") - F.col("_m")
    out = rows.groupBy("hold", "feature").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.max("_m").alias("mean"),
        F.sum(F.col("n") * (F.col("v") + dm * dm)).alias("ss"),
        F.sum("np").alias("pairs"),
        F.sum(F.col("np") * (F.col("vx") + dx * dx)).alias("_sxx"),
        F.sum(F.col("np") * (F.col("vy") + dy * dy)).alias("_syy"),
        F.sum(F.col("np") * (F.col("cxy") + dx * dy)).alias("_sxy"),
        ((F.min("lox") < F.max("hix")) & (F.min("loy") < F.max("hiy"))).alias("_varies"))
    corr = F.when(F.col("_varies"), F.try_divide(
        F.col("_sxy"), F.sqrt(F.col("_sxx")) * F.sqrt(F.col("_syy"))))
    return out.withColumn("corr", corr).drop("_sxx", "_syy", "_sxy", "_varies")


def corr_guard(fold_stats: DataFrame, limit: float = fixed.CORR_LIMIT, min_rows: int = 10
               ) -> DataFrame:
    """Drops features that nearly equal the label on the training cells of the fold."""
    kept = (F.col("pairs") < min_rows) | F.col("corr").isNull() | (F.abs("corr") < limit)
    return fold_stats.withColumn("kept", kept)


def fold_medians(samples: DataFrame, features: Sequence[str], label: str, roles: DataFrame
                 ) -> DataFrame:
    """Exact training median per (hold, feature), from counts per cell: no sample meets a fold."""
    train = roles.where(F.col("role") == "train").select("hold", "cell_id")
    return subset_quantiles(long_features(samples, features, label), ["feature"], "cell_id", "x",
                            train, "hold").withColumnRenamed("quantile", "median")


def fold_scaling(fold_stats: DataFrame, medians: DataFrame) -> DataFrame:
    """Median for missing values, then mean and deviation of the imputed training values."""
    n, k = F.col("n"), F.col("n_null")
    med, m = F.coalesce("median", F.lit(0.0)), F.coalesce("mean", F.lit(0.0))
    mean = (n * m + k * med) / (n + k)
    ss = (F.coalesce("ss", F.lit(0.0)) + n * (m - mean) * (m - mean)
          + k * (med - mean) * (med - mean))
    std = F.sqrt(ss / (n + k))
    return (fold_stats.join(medians, ["hold", "feature"], "left")
            .withColumns({"fill": med, "center": mean,
                          "scale": F.when(std < 1e-12, F.lit(1.0)).otherwise(std)}))


def fold_prepare(samples: DataFrame, features: Sequence[str], label: str,
                 limit: float = fixed.CORR_LIMIT, fill_missing: bool = True,
                 roles: DataFrame | None = None) -> DataFrame:
    """Plan of every fold: kept features with fill, center and scale from its training cells.

    ``features`` have passed the name guard. ``fill_missing=False`` saves the median pass for
    samples without missing values. ``roles`` is :func:`fold_roles` where it is already at hand.
    """
    roles = fold_roles(samples) if roles is None else roles
    stats = corr_guard(fold_statistics(cell_statistics(samples, features, label), roles), limit)
    if not fill_missing:
        return fold_scaling(stats, stats.select("hold", "feature", F.lit(0.0).alias("median")))
    return fold_scaling(stats, fold_medians(samples, features, label, roles))


def scaled_fold(samples: DataFrame, plan: Sequence, vector: str = "features") -> DataFrame:
    """Imputed and scaled feature vector of one fold; ``plan`` is its few collected rows."""
    from pyspark.ml.functions import array_to_vector

    values = [(F.coalesce(quoted(r["feature"]).cast("double"), F.lit(r["fill"]))
               - F.lit(r["center"])) / F.lit(r["scale"]) for r in plan if r["kept"]]
    return samples.withColumn(vector, array_to_vector(F.array(*values)))
