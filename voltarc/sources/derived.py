"""Telemetry derived from the event table, and arrays derived from the embedding table.

No cell telemetry ships with the test tables, so each event becomes one sample: events are spread
over cells, ordered in time, and cut into cycles of fixed length whose voltage, current,
temperature and charge follow a simple charge / flight / rest profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltarc.functions import ordered

CELLS = 8
CYCLE_ROWS = 50


def telemetry_from_events(events: DataFrame) -> DataFrame:
    base = events.select(
        "event_id", "ts", "value", F.pmod("user_id", F.lit(CELLS)).cast("int").alias("c"))
    blocks = ordered.range_blocks(base, ["c", "ts", "event_id"])
    numbered = ordered.with_position(blocks, ["c"], ["ts", "event_id"], "rn", total="n")
    sample = numbered.select(
        "event_id", "value", "c",
        F.floor(F.col("rn") / F.lit(CYCLE_ROWS)).cast("int").alias("cyc"),
        (F.col("rn") % CYCLE_ROWS).cast("int").alias("p"),
        (F.floor(F.col("n") / F.lit(CYCLE_ROWS)) + 1).cast("double").alias("nc")
    ).withColumn("ct", F.col("cyc") % 5 == 0)

    p, ct, eid, cyc = F.col("p"), F.col("ct"), F.col("event_id"), F.col("cyc")
    flying = p.between(22, 43)
    code = (F.when(eid % 1999 == 1998, F.lit(None))
            .when(p < 10, 0).when(p < 18, 1).when(ct, 9).when(p < 20, 2).when(p < 22, 3)
            .when(p < 27, 4).when(p < 39, 5).when(p < 44, 6).when(p < 46, 7).when(p < 48, 8)
            .otherwise(9))
    volts = (F.when(p < 18, F.lit(3.0) + F.lit(0.06) * p)
             .when(ct, F.lit(4.1) - F.lit(0.045) * (p - 18))
             .otherwise(F.lit(4.1) - F.lit(0.035) * (p - 18))
             + (eid % 11) / F.lit(200.0)
             + F.when(eid % 997 == 996, F.lit(0.8)).otherwise(F.lit(0.0)))
    amps = (F.when(p < 18, -(F.lit(1000.0) + F.lit(2.0) * F.col("value")))
            .when(ct, F.lit(1000.0) + F.lit(0.5) * F.col("value"))
            .when(flying, F.lit(3000.0) + F.lit(8.0) * F.col("value"))
            .otherwise(F.lit(5.0)))
    return sample.select(
        eid.alias("sample_id"),
        F.format_string("VAH%02d", F.col("c") + 1).alias("cell_id"),
        cyc.alias("cycleNumber"),
        code.cast("int").alias("Ns"),
        (p * 60 + eid % 7).cast("double").alias("time_s"),
        volts.alias("Ecell_V"),
        (F.when(F.col("c") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * amps).alias("I_mA"),
        (F.lit(20.0) + F.lit(0.5) * (eid % 23)
         + F.when(flying, F.lit(8.0)).otherwise(F.lit(0.0))).alias("Temperature__C"),
        (F.greatest(p - 18, F.lit(0)) / F.lit(31.0) * F.lit(3000.0)
         * (F.lit(1.0) - F.lit(0.3) * cyc / F.col("nc"))
         * F.when(ct, F.lit(1.0)).otherwise(F.lit(0.6))).alias("QDischarge_mA_h"),
        (F.least(p, F.lit(18)) / F.lit(18.0) * F.lit(2900.0)).alias("QCharge_mA_h"))


def arrays_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Attention-like weights (softmax of a vector) and gate logits (the vector itself)."""
    from voltarc.functions.columns import softmax

    wide = F.transform("embedding", lambda x: x.cast("double"))
    return embeddings.select(
        "vec_id", softmax(wide).alias("attention"),
        wide.alias("gate_logits"))
