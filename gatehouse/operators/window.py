"""A reference window that is kept: counted feature values of days, and the cohort statistics of every version.

A day adds its value counts (source, feature, value, n) as one part; parts add up, so no day is read again, and a day that is added twice
counts once. fit() adds the counts of all days up to now, makes exact medians and MADs of them and keeps these as the next version, a small
table of cohorts x features. score() holds documents, of a batch or of a stream, against one version, which later days don't change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.functions import lexicon as X
from gatehouse.operators import outliers
from gatehouse.sources.commits import CommitLog, State

COUNTS = "source string, feature string, value double, n long"
STATS = "pooled boolean, source string, feature string, n long, med double, mad double"


class Window:
    def __init__(self, spark: SparkSession, path: str, names: Sequence[str] = X.FEATURES):
        self.spark, self.names, self.log = spark, tuple(names), CommitLog(spark, path)

    def _keep(self, rows: DataFrame, kind: str, batch: int) -> None:
        path = self.log.folder()
        rows.write.parquet(path)
        self.log.commit(lambda state: [{"do": "part", "writer": "window", "kind": kind, "batch": batch, "path": path}])

    @staticmethod
    def _parts(state: State, kind: str) -> dict[int, str]:
        return {b: p for (_, k, b), p in sorted(state.parts.items()) if k == kind}

    def add(self, features: DataFrame, day: int) -> None:
        """The counted values of a day's documents (source and the named features)."""
        self._keep(outliers.counted(features.select("source", *[F.col(n).cast("double").alias(n) for n in self.names]), self.names).where("value IS NOT NULL"), "day", day)

    def counts(self, upto: int | None = None) -> DataFrame:
        """The added counts of all days, or of those up to one; a value has a row for each day that has it."""
        paths = [p for d, p in self._parts(self.log.state(), "day").items() if upto is None or d <= upto]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def fit(self, upto: int | None = None) -> int:
        """Keeps the statistics of all days, or of those up to one, as a new version, and returns its number."""
        version = max(self.versions(), default=0) + 1
        self._keep(outliers.fit_counts(self.counts(upto)).coalesce(1), "stats", version)
        return version

    def versions(self) -> list[int]:
        return list(self._parts(self.log.state(), "stats"))

    def stats(self, version: int | None = None) -> DataFrame:
        """The statistics of a version, of the last if none is named; as of outliers.fit()."""
        kept = self._parts(self.log.state(), "stats")
        return self.spark.read.schema(STATS).parquet(kept[version or max(kept)])

    def score(self, features: DataFrame, version: int | None = None, z: float = outliers.Z, min_cohort: int = outliers.MIN_COHORT) -> DataFrame:
        """outliers.score() against a version; features may be a stream."""
        return outliers.score(features, self.stats(version), z, min_cohort, self.names)
