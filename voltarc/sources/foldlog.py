"""Held-out predictions as a log of commits in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FoldLog:
    """Predictions of one task and group of models. A commit writes a table of its own and then a
    manifest entry that names it and the held-out cells it covers; what has no entry is not read, so
    a run that was lost half-way leaves nothing behind that counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("commit string, hold string").parquet(
                f"{self.folder}/manifest/*")
        except AnalysisException:  # no commit yet
            return None

    def holds(self) -> set[str] | None:
        """Held-out cells that are done, one name per fold; None before the first commit."""
        manifest = self._manifest()
        return None if manifest is None else {
            r["hold"] for r in manifest.where("hold is not null").collect()}

    def commit(self, predictions: DataFrame, holds: list[str]) -> None:
        name = uuid.uuid4().hex
        predictions.write.parquet(f"{self.folder}/data/{name}")
        (self.spark.range(1).select(F.lit(name).alias("commit"), F.explode(F.array(
            F.lit(None).cast("string"), *[F.lit(h) for h in holds])).alias("hold"))
         .coalesce(1).write.parquet(f"{self.folder}/manifest/{name}"))

    def table(self) -> DataFrame:
        """All committed predictions."""
        commits = sorted({r["commit"] for r in self._manifest().select("commit").distinct()
                          .collect()})
        return self.spark.read.parquet(*[f"{self.folder}/data/{c}" for c in commits])
