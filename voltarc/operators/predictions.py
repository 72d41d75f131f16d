"""Metrics, consistency checks and calibration of predictions; array summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed, ordered

KEYS = ["cell_id", "mission_id"]


def prediction_table(df: DataFrame) -> DataFrame:
    """Key columns first."""
    names = [c for c in ["cell_id", "mission_id", "seg_or_mission"] if c in df.columns]
    return df.select(*names, *[c for c in df.columns if c not in names])


def scored_columns(df: DataFrame) -> tuple[Column, Column]:
    """Post-processed truth and prediction when present."""
    if "y_pred_pp" in df.columns:
        return F.col("y_true_pp"), F.col("y_pred_pp")
    return F.col("y_true"), F.col("y_pred")


def per_cell_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    truth, guess = scored_columns(predictions)
    error = guess - truth
    return predictions.groupBy(*by, "cell_id").agg(
        F.avg(F.abs(error)).alias("MAE"), F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.count(F.lit(1)).alias("N"))


def fleet_metrics(per_cell: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Second-level summary: one input row per cell."""
    half = F.lit(0.5)
    return per_cell.groupBy(*by).agg(
        F.countDistinct("cell_id").alias("num_cells"), F.sum("N").alias("total_samples"),
        F.avg("MAE").alias("MAE_mean"), F.percentile("MAE", half).alias("MAE_median"),
        F.avg("RMSE").alias("RMSE_mean"), F.percentile("RMSE", half).alias("RMSE_median"))


def model_comparison(per_cell: DataFrame, order: Sequence[str] = tuple(fixed.MODEL_ORDER)
                     ) -> DataFrame:
    """Fleet means per task and model in the fixed model order; other models are left out."""
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(order) for x in (m, i)])
    return (per_cell.where(F.col("model").isin(list(order))).groupBy("task", "model")
            .agg(F.avg("MAE").alias("MAE_mean"), F.avg("RMSE").alias("RMSE_mean"),
                 F.countDistinct("cell_id").alias("N_cells"), F.sum("N").alias("N_total"))
            .withColumn("model_rank", F.try_element_at(rank, F.col("model")))
            .orderBy("task", "model_rank"))


def across_levels(predictions: DataFrame, column: str | None = None,
                  levels: Sequence[int] = tuple(fixed.EOL_SWEEP)) -> DataFrame:
    """One row per mission that has a prediction at every level: columns ``p80, p85, p90``."""
    column = column or ("y_pred_pp" if "y_pred_pp" in predictions.columns else "y_pred")
    at = {level: F.col("eol") == level for level in levels}
    wide = predictions.where(F.col("eol").isin(list(levels))).groupBy(*KEYS).agg(
        *[F.max(F.when(on, F.col(column))).alias(f"p{level}") for level, on in at.items()],
        *[F.count_if(on).alias(f"_has{level}") for level, on in at.items()])
    for level in levels:
        wide = wide.where(F.col(f"_has{level}") > 0).drop(f"_has{level}")
    return wide


def rul_monotonicity(wide: DataFrame) -> DataFrame:
    """Share of missions whose remaining life grows with the end-of-life level."""
    up1, up2 = F.col("p85") > F.col("p80"), F.col("p90") > F.col("p85")

    def share(flag: Column) -> Column:
        return F.avg(flag.cast("double"))

    return wide.agg(share(up1).alias("viol_85_gt_80"), share(up2).alias("viol_90_gt_85"),
                    share(up1 | up2).alias("viol_any"), F.count(F.lit(1)).alias("N"))


def with_isotonic(wide: DataFrame) -> DataFrame:
    """Least-squares non-increasing fit of the three levels, in closed form.

    The fit at level i is the smallest, over starts j <= i, of the largest, over ends k >= i,
    mean of levels j..k.
    """
    a, b, c = F.col("p80"), F.col("p85"), F.col("p90")
    ab, bc = (a + b) / F.lit(2.0), (b + c) / F.lit(2.0)
    abc = (a + b + c) / F.lit(3.0)
    from_a, from_b = F.greatest(ab, abc), F.greatest(b, bc)
    return wide.withColumns({
        "cal80": F.greatest(a, ab, abc),
        "cal85": F.least(from_a, from_b),
        "cal90": F.least(abc, bc, c)})


def isotonic_summary(calibrated: DataFrame) -> DataFrame:
    """Violation rate before and after; a rise below 1e-9 is rounding and does not count."""
    def rate(x: str, y: str, z: str, slack: float) -> Column:
        bad = (F.col(y) > F.col(x) + slack) | (F.col(z) > F.col(y) + slack)
        return F.avg(bad.cast("double"))

    return calibrated.agg(rate("p80", "p85", "p90", 0.0).alias("viol_before"),
                          rate("cal80", "cal85", "cal90", 1e-9).alias("viol_after"),
                          F.count(F.lit(1)).alias("N"))


def attach_calibrated(predictions: DataFrame, calibrated: DataFrame) -> DataFrame:
    """``y_pred_cal`` joined back to the prediction of each mission and level."""
    long = calibrated.select(*KEYS, F.explode(F.array(*[
        F.struct(F.lit(level).alias("eol"), F.col(f"cal{level}").alias("y_pred_cal"))
        for level in fixed.EOL_SWEEP])).alias("_c")).select(*KEYS, "_c.*")
    return predictions.join(long, [*KEYS, "eol"], "left")


def with_cascade(wide: DataFrame) -> DataFrame:
    """Simple repair: each level is capped by the one before."""
    mid = F.least("p85", "p80")
    return wide.withColumns({"cas80": F.col("p80"), "cas85": mid, "cas90": F.least("p90", mid)})


def soh_reconstruct(predictions: DataFrame, current: DataFrame) -> DataFrame:
    """Absolute SOH from predicted drops: current SOH minus drop, clipped to 0-100.

    ``current`` has ``cell_id, mission_id, SOH_end_pct``; every prediction must find its row.
    """
    now = current.select(*KEYS, F.col("SOH_end_pct").alias("SOH_now"))
    return predictions.join(now, KEYS).withColumns({
        "y_true_pp": C.clip(F.col("SOH_now") - F.col("y_true"), 0.0, 100.0),
        "y_pred_pp": C.clip(F.col("SOH_now") - F.col("y_pred"), 0.0, 100.0)})


def rul_increase_audit(predictions: DataFrame, by: Sequence[str] = ("eol",)) -> DataFrame:
    """Mean rise of predicted life from one mission to the next: mean per cell, then over cells."""
    keys = ["cell_id", *by]
    placed = ordered.with_position(ordered.number_blocks(predictions, "mission_id"), keys,
                                   ["mission_id"], "_pos")
    halo = ordered.Halo(placed, keys, "_pos", before=1)
    rise = F.col("y_pred") - F.lag("y_pred").over(halo.window)
    rows = halo.own(halo.rows.withColumn("_rise", F.when(
        rise.isNotNull(), F.greatest(rise, F.lit(0.0)))))
    per_cell = rows.groupBy(*keys).agg(F.avg("_rise").alias("_mean"),
                                       F.count("_rise").alias("_n")).where(F.col("_n") > 0)
    return per_cell.groupBy(*by).agg(F.avg("_mean").alias("mean_increase"),
                                     F.count(F.lit(1)).alias("n_cells"))


def attention_summary(arrays: DataFrame, column: str = "attention") -> DataFrame:
    """Position (0-based) and size of the largest weight, and normalized entropy (NULL at
    length 1)."""
    a = F.col(column)
    shares = C.let(F.struct(a.alias("a"), (C.array_sum(a) + F.lit(1e-12)).alias("sum")),
                   lambda s: F.transform(s["a"], lambda x: x / s["sum"]))
    entropy = F.aggregate(shares, F.lit(0.0),
                          lambda acc, p: acc - p * F.log(p + F.lit(1e-12)))
    size = F.size(a)
    return arrays.withColumns({
        "length": size,
        "attn_argmax": (F.array_position(a, F.array_max(a)) - 1).cast("int"),
        "attn_max": F.array_max(a),
        "attn_entropy": F.when(size > 1, entropy / F.log(size.cast("double"))
                               ).when(size == 0, F.lit(0.0))})


def gate_top2(arrays: DataFrame, column: str = "gate_logits") -> DataFrame:
    """The two largest gate weights (softmax of the logits) and their 0-based positions."""
    weights = C.softmax(F.col(column))
    ranked = F.array_sort(F.transform(weights, lambda x, i: F.struct(
        (-x).alias("neg"), i.alias("idx"))))
    return arrays.withColumn("_r", ranked).withColumns({
        "gate_top1": F.col("_r")[0]["idx"], "gate_pi_top1": -F.col("_r")[0]["neg"],
        "gate_top2": F.try_element_at("_r", F.lit(2))["idx"],
        "gate_pi_top2": -F.try_element_at("_r", F.lit(2))["neg"]}).drop("_r")


def gate_entropy(arrays: DataFrame, column: str = "gate_logits") -> DataFrame:
    """Normalized entropy of the gate weights, averaged over rows."""
    pi = C.softmax(F.col(column), slack=0.0, floor=1e-8)
    entropy = F.aggregate(pi, F.lit(0.0), lambda acc, x: acc - x * F.log(x))
    size = F.size(column).cast("double")
    return arrays.agg(F.avg(F.when(size > 1, entropy / F.log(size))).alias("gate_entropy"),
                      F.count(F.lit(1)).alias("n"))
