"""Catalog queries against their SQL on the test tables, with tiny blocks so that every ordered
operator crosses block borders, and invariants of the pipeline."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from voltarc.functions import ordered
from voltarc.operators import cycles as cy
from voltarc.operators import segments
from voltarc.plans.catalog import QUERIES
from voltarc.plans.pipeline import Pipeline

SCALE = "0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf{SCALE}"), reason="no test tables")


@pytest.fixture(scope="module")
def pipeline(spark):
    patch = pytest.MonkeyPatch()
    patch.setattr(ordered, "BLOCK_ROWS", 7)
    yield Pipeline.from_tables(spark, f"{DATA}/sf{SCALE}")
    patch.undo()


@pytest.fixture(scope="module")
def con(duck):
    return duck(SCALE)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.source is not None])
def test_query_equals_sql(name, pipeline, con, same):
    query = QUERIES[name]
    same(query.spark(pipeline), con.execute(query.sql()).fetchdf())


def test_soc_stays_in_range(pipeline):
    low, high = pipeline.samples().agg(F.min("SOC"), F.max("SOC")).first()
    assert 0.0 <= low and high <= 100.0


def test_segment_durations_add_up(pipeline):
    spaced = segments.with_segments(cy.with_spacing(pipeline.telemetry))
    total = spaced.where("Ns IS NOT NULL").agg(F.sum("dt")).first()[0]
    assert pipeline.phases.agg(F.sum("duration_s")).first()[0] == pytest.approx(total)


def test_compat_switch_reports_no_second_rest(pipeline):
    from voltarc.operators.exploration import mission_table
    assert mission_table(pipeline.phases, compat=True).agg(F.max("dur_rest2_s")).first()[0] == 0


def test_last_rows_are_the_last_steps(pipeline):
    from voltarc.operators import sequences
    rows, features = sequences.mission_rows(pipeline.dictionary_mission)
    windows = sequences.mission_sequences(rows, features, "SOH_end_pct")
    names = ["cell_id", "mission_id", *features, "label"]
    want = sequences.last_step(windows, features).select(*[F.col(f"`{n}`") for n in names])
    got = sequences.last_rows(rows, features, "SOH_end_pct")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
