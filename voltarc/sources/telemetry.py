"""Readers of raw telemetry files and checks on their schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltarc.functions import columns as C
from voltarc.functions import fixed

RAW_SCHEMA = T.StructType([
    T.StructField("time_s", T.DoubleType()),
    T.StructField("Ecell_V", T.DoubleType()),
    T.StructField("I_mA", T.DoubleType()),
    T.StructField("QDischarge_mA_h", T.DoubleType()),
    T.StructField("QCharge_mA_h", T.DoubleType()),
    T.StructField("Temperature__C", T.DoubleType()),
    T.StructField("cycleNumber", T.IntegerType()),
    T.StructField("Ns", T.IntegerType()),
])
OPTIONAL = T.StructType([
    T.StructField("EnergyDischarge_W_h", T.DoubleType()),
    T.StructField("EnergyCharge_W_h", T.DoubleType()),
    T.StructField("sample_id", T.LongType()),
])
CELL_PATTERN = r"(VAH[^/._]*)[^/]*(?:/part-[^/]*)?$"


def read_telemetry(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Scan one or many telemetry CSV files.

    ``paths`` is a file, a glob such as ``dir/VAH*.csv``, or a list. Columns go by the names in
    the header, in any order; types are declared here and nothing is inferred. All files of one
    call share one header, which is verified per file. The cell comes from the file stem (or from
    a ``VAH..`` directory that Spark wrote); file order is kept in ``sample_id`` unless the files
    have that column.
    """
    kinds = {f.name: f.dataType for f in [*RAW_SCHEMA.fields, *OPTIONAL.fields]}
    reader = spark.read.option("header", True)
    names = reader.csv(paths).columns
    schema = T.StructType([
        T.StructField(n, kinds.get(n.strip(), T.StringType())) for n in names])
    raw = trimmed(reader.option("enforceSchema", False).schema(schema).csv(paths))
    out = raw.withColumns({
        n: C.known(F.col(n)) for n in raw.columns if kinds.get(n) == T.DoubleType()})
    out = out.withColumn("cell_id", F.regexp_extract(F.input_file_name(), CELL_PATTERN, 1))
    if "sample_id" not in out.columns:
        out = out.withColumn("sample_id", F.monotonically_increasing_id())
    return out


def required_columns(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``(dataset, column_name, n_values, is_missing)`` for each required column of each table.

    A column is missing when the table lacks it; ``n_values`` counts its values otherwise.
    """
    out = None
    for name, (df, required) in tables.items():
        counts = df.agg(*[
            (F.count(c) if c in df.columns else F.lit(0).cast("long")).alias(c)
            for c in required])
        rows = counts.select(F.explode(F.array(*[F.struct(
            F.lit(name).alias("dataset"), F.lit(c).alias("column_name"),
            F.col(c).alias("n_values"), F.lit(c not in df.columns).alias("is_missing"))
            for c in required])).alias("_r")).select("_r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def pruned_scan(df: DataFrame, wanted: Sequence[str] = fixed.PRUNED_SAMPLES,
                keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Only the wanted columns; absent ones become NULL."""
    kinds = {f.name: f.dataType.simpleString() for f in RAW_SCHEMA}
    full = C.null_missing(df, {name: kinds.get(name, "double") for name in wanted})
    return full.select(*keys, *[c for c in wanted if c not in keys])


def trimmed(df: DataFrame) -> DataFrame:
    """Strip blanks around column names of a reloaded stage."""
    return df.toDF(*[c.strip() for c in df.columns])
