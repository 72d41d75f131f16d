"""Readers, schema checks and sinks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltarc.operators import cycles
from voltarc.sources import ragged, stages, telemetry

HEADER = "time_s,Ecell_V,I_mA,QDischarge_mA_h,QCharge_mA_h,Temperature__C,cycleNumber,Ns\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    (path / "VAH01.csv").write_text(HEADER + "0,3.5,1,0,0,20,0,0\n1,NaN,2,0,0,20,0,\n")
    (path / "VAH27.csv").write_text(HEADER + "0,3.6,1,0,0,20,0,4\n")
    (path / "notes.csv").write_text("x\n1\n")
    return path


def test_scan_takes_the_cell_from_the_file_name(spark, folder):
    df = telemetry.read_telemetry(spark, str(folder / "VAH*.csv"))
    rows = df.orderBy("cell_id", "time_s").collect()
    assert [r["cell_id"] for r in rows] == ["VAH01", "VAH01", "VAH27"]
    assert rows[1]["Ecell_V"] is None and rows[1]["Ns"] is None
    assert telemetry.read_telemetry(spark, str(folder / "VAH27.csv")).count() == 1


def test_columns_go_by_name_in_any_order(spark, tmp_path):
    (tmp_path / "VAH05.csv").write_text(
        "Ns,time_s,Ecell_V,I_mA,EnergyDischarge_W_h,QDischarge_mA_h,QCharge_mA_h,"
        "Temperature__C,cycleNumber,comment\n"
        "4,0,3.5,1,2.5,0,0,20,7,a\n6,1,3.5,1,3.5,0,0,20,7,b\n")
    df = telemetry.read_telemetry(spark, str(tmp_path / "VAH05.csv"))
    assert df.schema["Ns"].dataType == T.IntegerType()
    facts = cycles.cycle_facts(df).first()
    assert facts["cycleNumber"] == 7 and facts["is_mission"]
    assert facts["energy_discharge"] == 3.5 and facts["energy_charge"] is None


def test_json_record_per_cell(spark, tmp_path):
    rows = spark.createDataFrame([("VAH01", 3, 2)], "cell_id string, n_rows int, n_cycles int")
    stages.write_table(rows, str(tmp_path / "meta"), partition_by=(), fmt="json")
    assert spark.read.json(str(tmp_path / "meta")).first()["n_rows"] == 3


def test_array_columns_survive_the_sink(spark, tmp_path):
    rows = spark.createDataFrame([("VAH01", [0.5, 0.5]), ("VAH01", [1.0])],
                                 "cell_id string, attention array<double>")
    stages.write_table(rows, str(tmp_path / "extras"))
    back = spark.read.parquet(str(tmp_path / "extras")).select("attention").collect()
    assert sorted(r[0] for r in back) == [[0.5, 0.5], [1.0]]


def test_required_and_pruned(spark, folder):
    df = telemetry.read_telemetry(spark, str(folder / "VAH*.csv"))
    rows = {r["column_name"]: r for r in telemetry.required_columns(
        {"raw": (df, ["Ns", "SOC"])}).collect()}
    assert (rows["Ns"]["n_values"], rows["Ns"]["is_missing"]) == (2, False)
    assert (rows["SOC"]["n_values"], rows["SOC"]["is_missing"]) == (0, True)
    pruned = telemetry.pruned_scan(df)
    assert pruned.columns[0] == "cell_id" and pruned.where("SOC IS NOT NULL").count() == 0


def test_profile_drops_constant_and_empty_columns(spark):
    df = spark.createDataFrame(
        [("VAH01", 1, 5.0, 7, None, 1.0), ("VAH01", 2, None, 7, None, 1.0),
         ("VAH01", 3, None, 7, 1.0, 1.0)],
        "cell_id string, sample_id int, sparse double, flat int, mixed double, time_s double")
    kept = cycles.drop_uninformative(df).columns
    assert kept == ["cell_id", "sample_id", "time_s"]  # time_s is constant but required


def test_sink_and_union_by_name(spark, tmp_path):
    a = spark.createDataFrame([("VAH01", 1, 2.0)], "cell_id string, n int, x double")
    b = spark.createDataFrame([("VAH02", 3)], "cell_id string, n int")
    stages.write_table(a, str(tmp_path / "a"))
    stages.write_table(b, str(tmp_path / "b"))
    back = stages.read_tables(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {(r["cell_id"], r["n"], r["x"]) for r in back.collect()} == {
        ("VAH01", 1, 2.0), ("VAH02", 3, None)}
    assert (tmp_path / "a" / "cell_id=VAH01").is_dir()
    padded = a.toDF(" cell_id", "n ", " x ")
    assert telemetry.trimmed(padded).columns == a.columns


def test_bucketed_stage_needs_no_shuffle(spark):
    store = stages.StageStore(spark)
    df = spark.range(200).select(
        F.format_string("VAH%02d", F.col("id") % 3).alias("cell_id"),
        (F.col("id") / 10).cast("int").alias("cycleNumber"), "id")
    table = store.bucketed("probe", df, ["cell_id", "cycleNumber"], ["cell_id", "cycleNumber"])
    joined = table.join(table.groupBy("cell_id", "cycleNumber").agg(F.count("*").alias("n")),
                        ["cell_id", "cycleNumber"])
    plan = joined.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert joined.count() == 200


def test_rejected_cells(spark, folder):
    df = telemetry.read_telemetry(spark, str(folder / "VAH*.csv")).where(
        "cell_id = 'VAH01' OR Ns IS NOT NULL")
    table = spark.createDataFrame([("VAH01", False)], "cell_id string, is_capacity_test boolean")
    got = {r["cell_id"]: r["reason"] for r in cycles.rejected_cells(df, table).collect()}
    assert got == {"VAH01": "no capacity test", "VAH27": "no cycle summary"}


def test_ragged_arrays_come_back(spark, tmp_path):
    """Arrays over page borders, longer than pages, empty, NULL, with repeated and NULL keys."""
    rows = [(i % 9 if i % 10 else None, None if i % 7 == 6 else [float(i * 100 + k) for k in range(
        (i * 5) % 23)]) for i in range(60)] + [(1, [1.0, 2.0])] * 3
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(3)
    path = str(tmp_path / "ragged")
    ragged.write_ragged(df, ["k"], "v", path, page=8)
    pages = spark.read.parquet(f"{path}/values").select(F.size("values")).collect()
    assert max(r[0] for r in pages) == 8 and len(pages) <= sum(len(v or []) for _, v in rows) / 8 + 3
    back = ragged.read_ragged(spark, path)
    assert back.schema == df.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    some = ragged.read_ragged(spark, path, spark.createDataFrame([(3,), (3,), (77,)], "k int"))
    assert sorted(map(str, some.collect())) == sorted(map(str, df.where("k = 3").collect()))


def test_ragged_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, v array<double>")
    ragged.write_ragged(empty, ["k"], "v", str(tmp_path / "none"))
    assert ragged.read_ragged(spark, str(tmp_path / "none")).count() == 0
