"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltarc.functions import fixed


def known(values: Column) -> Column:
    """NaN is missing: map it to NULL."""
    return F.when(~F.isnan(values), values)


def lookup(values: Mapping, key: Column, default: str) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def phase_name(code: Column) -> Column:
    return lookup(fixed.PHASES, code.cast("int"), "unknown")


def phase_family(name: Column) -> Column:
    return lookup(fixed.FAMILIES, name, "other")


def cell_condition(cell: Column) -> Column:
    return lookup(fixed.CONDITIONS, cell, "unknown")


def power_w(voltage: Column, current_ma: Column) -> Column:
    return voltage * current_ma / F.lit(1000.0)


def ratio(top: Column, bottom: Column) -> Column:
    """Division with a zero divisor mapped to NULL."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def at_least_zero(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0).cast("double")))


def standard_current(current_ma: Column, sign: Column) -> Column:
    """Current with discharge negative."""
    return current_ma * F.when(sign > 0, F.lit(-1)).otherwise(F.lit(1))


def masked(condition: Column, value: Column) -> Column:
    """Value where the condition holds, else 0; missing values count as 0."""
    return F.when(condition, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def snap_setpoint(p95: Column) -> Column:
    snapped = F.round(p95, 2)
    for level in reversed(fixed.CV_SETPOINTS):
        snapped = F.when(F.abs(p95 - F.lit(level)) <= F.lit(fixed.CV_SNAP_V), F.lit(level)
                         ).otherwise(snapped)
    return F.when(p95.isNotNull(), snapped)


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column, slack: float = 1e-12, floor: float = 0.0) -> Column:
    """Max-shifted softmax; ``slack`` is added to the divisor and ``floor`` to each weight."""
    exps = let(F.struct(logits.alias("v"), F.array_max(logits).alias("top")),
               lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])))
    return let(exps, lambda e: let(
        F.struct(e.alias("e"), (array_sum(e) + F.lit(slack)).alias("sum")),
        lambda s: F.transform(s["e"], lambda x: x / s["sum"] + F.lit(floor))))


def null_missing(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Adds absent columns as typed NULLs."""
    return df.withColumns({
        name: F.lit(None).cast(kind) for name, kind in types.items() if name not in df.columns})
