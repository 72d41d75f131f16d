"""The staged pipeline: telemetry -> cycles -> phases -> features -> missions.

Stages are lazy properties. A stage that several operators share is written once to the shared
folder, so a lost executor re-reads a file instead of replaying the lineage. Samples and the tables
that are joined to them are bucketed by cell and cycle, so that this work needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from voltarc.operators import cycles as cy
from voltarc.operators import (exploration, folds, health, missions, physics, segments, sequences,
                               tables)
from voltarc.sources.derived import arrays_from_embeddings, telemetry_from_events
from voltarc.sources.foldlog import FoldLog
from voltarc.sources.stages import StageStore


class Pipeline:
    def __init__(self, spark: SparkSession, telemetry: Callable[[], DataFrame],
                 arrays: Callable[[], DataFrame] | None = None):
        self.spark = spark
        self.store = StageStore(spark)
        self._telemetry = telemetry
        self._arrays = arrays

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> "Pipeline":
        """Pipeline over telemetry derived from the event and embedding tables of ``folder``."""
        folder = folder.rstrip("/")
        return cls(
            spark,
            lambda: telemetry_from_events(spark.read.parquet(f"{folder}/events.parquet")),
            lambda: arrays_from_embeddings(spark.read.parquet(f"{folder}/embeddings.parquet")))

    def _bucketed(self, name: str, df: DataFrame, *order: str) -> DataFrame:
        return self.store.bucketed(name, df, cy.CYCLE, [*cy.CYCLE, *order])

    @cached_property
    def telemetry(self) -> DataFrame:
        return self._bucketed("telemetry", self._telemetry(), "time_s", "sample_id")

    @property
    def arrays(self) -> DataFrame:
        return self._arrays()

    @cached_property
    def facts(self) -> DataFrame:
        """Per-cycle facts: the only full pass over the samples that the cycle layer needs."""
        return self.store.plain("facts", cy.cycle_facts(self.telemetry))

    @cached_property
    def placed(self) -> DataFrame:
        return self.store.plain("placed", cy.with_cycle_position(self.facts))

    @cached_property
    def signs(self) -> DataFrame:
        return self.store.plain("signs", cy.discharge_sign(self.placed, self.telemetry))

    def capacity_features(self) -> DataFrame:
        return cy.capacity_features(self.placed, self.signs)

    @cached_property
    def scored(self) -> DataFrame:
        return self.store.plain("scored", cy.score_cycles(self.capacity_features()))

    @cached_property
    def tested(self) -> DataFrame:
        """Cycles with capacity evidence, score and flag."""
        return self.store.plain("tested", cy.flag_capacity_tests(self.scored))

    @cached_property
    def healthy(self) -> DataFrame:
        """Cycles with SOH and smoothed SOH."""
        return self.store.plain("healthy", health.with_smoothed_soh(health.with_soh(self.tested)))

    @cached_property
    def ends(self) -> DataFrame:
        """End-of-life and last cycle and mission of each cell."""
        return self.store.plain("ends", health.end_of_life(self.healthy))

    @cached_property
    def cycles(self) -> DataFrame:
        """The full cycle table: SOH, remaining life, missions and anomalies."""
        rul = health.with_cycle_rul(self.healthy, self.ends)
        return self._bucketed("cycles", cy.with_anomalies(rul, self.facts))

    def samples(self) -> DataFrame:
        """Cleaned samples: phase, power and SOC (no shuffle: both inputs share their buckets)."""
        return cy.with_power(segments.label_phases(health.with_soc(self.telemetry, self.cycles)))

    @cached_property
    def phases(self) -> DataFrame:
        return self._bucketed("phases", segments.phase_instances(
            health.with_soc(self.telemetry, self.cycles), self.cycles), "seg_id")

    def segmented(self) -> DataFrame:
        return segments.with_segments(self.telemetry)

    @cached_property
    def phase_features(self) -> DataFrame:
        return self.store.plain("phase_features", physics.phase_features(
            self.phases, self.segmented()))

    @cached_property
    def missions(self) -> DataFrame:
        return self.store.plain("missions", missions.mission_features(self.phase_features))

    @cached_property
    def setpoints(self) -> DataFrame:
        return self.store.plain("setpoints", physics.cv_setpoint(self.telemetry))

    @cached_property
    def dictionary_phase(self) -> DataFrame:
        return self.store.plain(
            "dictionary_phase", missions.dictionary_phase(self.phase_features))

    @cached_property
    def dictionary_mission(self) -> DataFrame:
        return self.store.plain("dictionary_mission", missions.dictionary_mission(
            self.dictionary_phase, self.setpoints))

    @cached_property
    def mission_table(self) -> DataFrame:
        return self.store.plain("mission_table", exploration.mission_table(self.phases))

    @cached_property
    def mission_degradation(self) -> DataFrame:
        return self.store.plain("mission_degradation",
                                exploration.mission_degradation(self.phases))

    # ---- model inputs: every fold reads them, so they are written once ----

    @cached_property
    def horizon(self) -> DataFrame:
        """Missions with filled features and the SOH drop over the horizon."""
        rows, _ = sequences.mission_rows(self.dictionary_mission)
        return self.store.plain("horizon", sequences.soh_horizon(rows))

    @cached_property
    def roles(self) -> DataFrame:
        """Role of every cell in every fold of the horizon samples."""
        return self.store.plain("roles", folds.fold_roles(self.horizon))

    @cached_property
    def rul_samples(self) -> DataFrame:
        rows, _ = sequences.mission_rows(self.dictionary_mission)
        return self.store.plain("rul_samples", sequences.rul_missions(rows))

    @cached_property
    def soc_samples(self) -> DataFrame:
        """Flight segments from the second of a mission on, with the SOC change as label."""
        rows, features = sequences.soc_rows(self.dictionary_phase)
        ids = sequences.soc_sequences(rows, features).select(*missions.MISSION, "seg_id")
        return self.store.plain("soc_samples", rows.join(ids, [*missions.MISSION, "seg_id"],
                                                         "left_semi"))

    @cached_property
    def pooled_horizon(self) -> DataFrame:
        features = tables.model_features("mission", self.horizon.columns)
        return self.store.plain("pooled_horizon", sequences.pooled(self.horizon, features))

    @cached_property
    def pooled_rul(self) -> DataFrame:
        rows, _ = sequences.mission_rows(self.dictionary_mission)
        features = tables.model_features("mission", rows.columns)
        return self.store.plain("pooled_rul", sequences.rul_missions(
            sequences.pooled(rows, features)))

    @cached_property
    def pooled_soc(self) -> DataFrame:
        """The samples of ``soc_samples`` with pools over the mission's segments so far."""
        rows, _ = sequences.soc_rows(self.dictionary_phase)
        features = tables.model_features("phase", rows.columns)
        samples = self.soc_samples.select(*missions.MISSION, "seg_id")
        return self.store.plain("pooled_soc", sequences.pooled_segments(rows, features).join(
            samples, [*missions.MISSION, "seg_id"], "left_semi"))

    def log(self, task: str, group: str) -> FoldLog:
        """Held-out predictions of a group of models for a task."""
        return FoldLog(self.spark, self.store.path(f"predictions/{task}-{group}"))

    @cached_property
    def soh_model_table(self) -> DataFrame:
        return self.store.plain("soh_model_table", tables.soh_table(self.missions))


_pipelines: dict[tuple[str, str], Pipeline] = {}


def pipeline(spark: SparkSession, folder: str) -> Pipeline:
    """One pipeline per running application and data folder, so its stages are written once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _pipelines:
        _pipelines[key] = Pipeline.from_tables(spark, folder)
    return _pipelines[key]
