"""Thermal, incremental-capacity and resistance features of segments; charge setpoint of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltarc.functions import columns as C
from voltarc.functions import fixed
from voltarc.functions.quantiles import group_quantiles, interpolated
from voltarc.operators.segments import SEGMENT


def with_thermal(segments: DataFrame) -> DataFrame:
    """Temperature rise per second, and per watt where mean |power| is at least 1 W."""
    slope = (F.col("max_temp_C") - F.col("mean_temp_C")) / F.greatest("duration_s", F.lit(1.0))
    power = F.col("mean_abs_power_W")
    return segments.withColumn("thermal_slope_K_per_s", slope).withColumn(
        "thermal_gain_K_per_W", F.when(
            power >= fixed.MIN_POWER_W, F.col("thermal_slope_K_per_s") / power))


def with_voltage_span(samples: DataFrame) -> DataFrame:
    """``vmin, vmax``: 2nd and 98th voltage percentile of the segment, on each of its samples.

    Kept are segments with at least 8 samples, a range of 0.05 V and no missing value. Ranks come
    from a sort by voltage, which spills, so that no segment has to fit in memory, and every
    window starts with the bucket columns, so that the samples are not shuffled.
    """
    whole_segment = Window.partitionBy(*SEGMENT)
    volts = F.col("Ecell_V")
    whole = volts.isNotNull() & F.col("I_mA").isNotNull() & F.col("time_s").isNotNull()
    sized = (samples.where(F.col("Ns").isNotNull()).withColumns({
        "_n": F.count(F.lit(1)).over(whole_segment), "_whole": F.min(whole).over(whole_segment)})
        .where(F.col("_whole") & (F.col("_n") >= fixed.IC_MIN_SAMPLES))
        .withColumn("_rank", F.row_number().over(whole_segment.orderBy("Ecell_V")) - 1))

    def at(rank):
        return F.max(F.when(F.col("_rank") == rank, volts)).over(whole_segment)

    ranks = {"vmin": F.lit(0.02) * (F.col("_n") - 1), "vmax": F.lit(0.98) * (F.col("_n") - 1)}
    spanned = sized.withColumns({
        f"{name}_{side}": at(take(rank)) for name, rank in ranks.items()
        for side, take in (("lo", F.floor), ("hi", F.ceil))})
    return (spanned.withColumns({
        name: interpolated(F.col(f"{name}_lo"), F.col(f"{name}_hi"), rank - F.floor(rank))
        for name, rank in ranks.items()})
        .drop("_n", "_whole", "_rank", "vmin_lo", "vmin_hi", "vmax_lo", "vmax_hi")
        .where(F.col("vmax") - F.col("vmin") >= fixed.IC_MIN_RANGE_V))


def ic_histogram(samples: DataFrame, bins: int = fixed.IC_BINS) -> DataFrame:
    """Charge per voltage bin of each segment (only bins that hold samples).

    ``samples`` carries ``seg_id``. Bins are half-open over the 2nd to 98th voltage percentile.
    """
    v = F.col("Ecell_V")
    in_order = Window.partitionBy(*SEGMENT).orderBy("time_s", "sample_id")
    hours = F.coalesce(F.col("time_s") - F.lag("time_s").over(in_order), F.lit(0.0)
                       ) / F.lit(3600.0)
    low, step = F.col("vmin"), (F.col("vmax") - F.col("vmin")) / F.lit(float(bins))
    guess = F.floor((v - low) / step)
    # the division may be off by one at a bin edge: compare with the edges themselves
    place = (F.when(v >= (guess + 1) * step + low, guess + 1)
             .when(v < guess * step + low, guess - 1).otherwise(guess))
    return (with_voltage_span(samples.withColumn("_dq", F.col("I_mA") * hours))
            .where((v >= low) & (v < F.col("vmax")))
            .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
            .groupBy(*SEGMENT, "bin")
            .agg(F.max("vmin").alias("vmin"), F.max("vmax").alias("vmax"),
                 F.sum("_dq").alias("charge_mAh")))


def ic_features(histogram: DataFrame, bins: int = fixed.IC_BINS) -> DataFrame:
    """Centroid, spread and the two highest peaks of the incremental-capacity curve.

    One aggregate per segment; moments are taken from the lower voltage edge. Absent bins count
    as 0: they add nothing to the moments and are the second peak where one bin holds all charge.
    """
    step = (F.col("vmax") - F.col("vmin")) / F.lit(float(bins))
    height = F.abs("charge_mAh")
    offset = (F.col("bin") + F.lit(0.5)) * step
    sums = histogram.groupBy(*SEGMENT).agg(
        F.max("vmin").alias("vmin"), F.max(step).alias("_step"),
        F.sum(height).alias("_total"), F.sum(height * offset).alias("_first"),
        F.sum(height * offset * offset).alias("_second"),
        F.sort_array(F.collect_list(F.struct(
            height.alias("h"), F.col("bin").alias("bin"), F.col("charge_mAh").alias("dq"))),
            asc=False).alias("_peaks")).where("_total > 0")
    mean = F.col("_first") / F.col("_total")
    top, after = F.col("_peaks")[0], F.get("_peaks", F.lit(1))
    last = F.lit(bins - 1)
    empty = F.when(top["bin"] == last, last - 1).otherwise(last)
    second = F.coalesce(F.when(after["h"] > 0, after["bin"]), empty)

    def middle(place):
        return F.col("vmin") + (place + F.lit(0.5)) * F.col("_step")

    per_volt = F.greatest("_step", F.lit(1e-6))
    variance = F.col("_second") / F.col("_total") - mean * mean
    return sums.select(
        *SEGMENT, (F.col("vmin") + mean).alias("ic_centroid_V"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("ic_spread_V"),
        middle(top["bin"]).alias("ic_peak1_V"), (top["dq"] / per_volt).alias("ic_peak1_height"),
        middle(second).alias("ic_peak2_V"),
        F.coalesce(F.when(after["h"] > 0, after["dq"]) / per_volt, F.lit(0.0)
                   ).alias("ic_peak2_height"))


def vi_resistance(samples: DataFrame) -> DataFrame:
    """Negative slope of voltage on current, for segments with 12 samples and varying current."""
    amps, v = F.col("I_mA") / F.lit(1000.0), F.col("Ecell_V")
    fits = samples.where(F.col("Ns").isNotNull()).groupBy(*SEGMENT).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(v.isNotNull(), amps)).alias("_pairs"),
        F.stddev_pop(amps).alias("_std"), (-F.regr_slope(v, amps)).alias("vi_slope_R_ohm"))
    return (fits.where((F.col("_n") >= fixed.VI_MIN_SAMPLES) & (F.col("_n") == F.col("_pairs"))
                       & (F.col("_std") >= fixed.VI_MIN_STD_A))
            .select(*SEGMENT, "vi_slope_R_ohm"))


def phase_features(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Segments of at least 2 s with thermal, incremental-capacity and resistance features."""
    kept = with_thermal(segments.where(F.col("duration_s") >= fixed.MIN_SEGMENT_S))
    return (kept.join(ic_features(ic_histogram(samples)), SEGMENT, "left")
            .join(vi_resistance(samples), SEGMENT, "left"))


def cv_setpoint(samples: DataFrame) -> DataFrame:
    """Charge voltage of each cell: 95th percentile over constant-voltage samples, snapped."""
    high = group_quantiles(samples.where(F.col("Ns") == 1), ["cell_id"], "Ecell_V",
                           {"v95": 0.95})
    return high.select("cell_id", "v95", C.snap_setpoint(F.col("v95")).alias("cv_setpoint_V"))
