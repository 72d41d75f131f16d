"""Modelling tables, one-hot columns and the guards that pick feature columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltarc.functions import fixed
from voltarc.operators.missions import MISSION, family_sum, of_missions
from voltarc.operators.segments import SEGMENT


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of a label column; each becomes a column of its own."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().collect()
    return sorted(str(r[0]) for r in rows)


def one_hot(df: DataFrame, columns: Sequence[str], drop: bool = True,
            values: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """0/1 columns ``<column>_<value>`` per category; a missing value gives all zeros. ``values``
    lists the categories of a column; a column it does not list is read once for them."""
    known = values or {}
    for c in [c for c in columns if c in df.columns]:
        df = df.withColumns({
            f"{c}_{value}": F.coalesce((F.col(c) == value).cast("int"), F.lit(0))
            for value in (known[c] if c in known else categories(df, c))})
        df = df.drop(c) if drop else df
    return df


def with_conditions(df: DataFrame) -> DataFrame:
    """One-hot columns of the optional test-condition columns, appended."""
    return one_hot(df, ["cell_condition", "test_condition"])


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def feature_names(spark: SparkSession, level: str, present: Sequence[str]) -> DataFrame:
    """Dictionary features of a level that the table has and that are no key or label."""
    listed = {"phase": fixed.PHASE_FEATURES, "mission": fixed.MISSION_FEATURES}[level.lower()]
    wanted = spark.createDataFrame([(i, f) for i, f in enumerate(listed)],
                                   "position int, feature string")
    have = spark.createDataFrame([(c,) for c in present] or [(None,)], "feature string")
    meta = spark.createDataFrame([(c,) for c in fixed.META_COLUMNS], "feature string")
    return (wanted.join(have, "feature", "left_semi").join(meta, "feature", "left_anti")
            .select("position", "feature"))


def model_features(level: str, present: Sequence[str]) -> list[str]:
    """Same choice as :func:`feature_names`, as a list for building projections."""
    listed = {"phase": fixed.PHASE_FEATURES, "mission": fixed.MISSION_FEATURES}[level.lower()]
    return [f for f in listed if f in present and f not in fixed.META_COLUMNS]


def leakage_name_guard(names: DataFrame, column: str = "feature") -> DataFrame:
    """Marks feature names that match one of the leakage patterns (substring search)."""
    low = F.lower(F.col(column))
    leaking = F.lit(False)
    for pattern in fixed.LEAK_PATTERNS:
        leaking = leaking | low.rlike(pattern)
    return names.withColumn("kept", ~leaking)


def safe_names(names: Sequence[str]) -> list[str]:
    """The names that :func:`leakage_name_guard` keeps."""
    import re
    return [n for n in names
            if not any(re.search(p, n.lower()) for p in fixed.LEAK_PATTERNS)]


def pick_soc_target(present: Sequence[str]) -> str:
    for name in fixed.SOC_TARGETS:
        if name in present:
            return name
    raise ValueError(f"none of {fixed.SOC_TARGETS} is present")


def soc_table(segments: DataFrame) -> DataFrame:
    """Complete mission segments: numeric features, one-hot phase and family, target SOC change."""
    base = of_missions(segments)
    numeric = [c for c in fixed.SOC_TABLE if c in base.columns]
    rows = base.select(*SEGMENT, *numeric, "phase_name", "phase_family",
                       F.col("delta_SOC").alias("target"))
    # categories come from all mission segments, complete or not
    return one_hot(rows, ["phase_name", "phase_family"]).dropna(subset=[*numeric, "target"])


def soh_table(missions: DataFrame) -> DataFrame:
    """Complete missions that have a next mission, target its SOH."""
    numeric = [c for c in fixed.SOH_TABLE if c in missions.columns]
    return missions.where(~F.col("is_last_mission")).select(
        *MISSION, *numeric, F.col("SOH_next_pct").alias("target")
    ).dropna(subset=[*numeric, "target"])


def rul_table(segments: DataFrame) -> DataFrame:
    """Complete missions with medians and energies, target remaining missions."""
    def median(name: str) -> Column:
        return F.percentile(name, F.lit(0.5))

    return of_missions(segments).groupBy(*MISSION).agg(
        F.max("RUL_missions_after_phase").alias("target"),
        median("thermal_gain_K_per_W").alias("thermal_gain_med"),
        median("mean_C_rate").alias("mean_C"), median("max_C_rate").alias("max_C"),
        median("max_temp_C").alias("max_T"), median("vi_slope_R_ohm").alias("vi_R"),
        median("ic_centroid_V").alias("ic_centroid_V"),
        family_sum("energy_Wh", "flight").alias("flight_Wh"),
        family_sum("energy_Wh", "charge").alias("charge_Wh"),
    ).select(*MISSION, *fixed.RUL_TABLE, "target").dropna()
