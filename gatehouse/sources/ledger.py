"""An append-only provenance ledger: Parquet parts under a commit log.

Every append is a batch with an id of its own; a batch that a writer writes twice (a retried micro-batch) is kept once, and several writers
may append at once. Rows are ordered by (batch, seq). The latest records are what compact() last wrote, and the batches since.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.sources.commits import CommitLog, State

RECORD = "doc_id string, source string, fetch_time string, modality string, extractor string, gate_quality double, decision string, responsible_stage string, config_hash string"
SCHEMA = f"batch long, seq long, {RECORD}, supersedes string, body string, kind string"
KINDS = ("record", "superseding", "summary")
_TYPES = dict(f.split() for f in SCHEMA.split(", "))


class Ledger:
    def __init__(self, spark: SparkSession, path: str, writer: str = "main"):
        self.spark, self.path, self.writer, self.log = spark, path, writer, CommitLog(spark, path)

    def _written(self, rows: DataFrame, batch: int, kind: str) -> dict:
        """The rows as a part that isn't committed yet."""
        rows = rows.withColumns({"batch": F.lit(batch).cast("long"), "seq": F.monotonically_increasing_id(), "kind": F.lit(kind)})
        path = self.log.folder()
        rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()]).write.parquet(path)
        return {"do": "part", "writer": self.writer, "kind": kind, "batch": batch, "path": path}

    def _add(self, rows: DataFrame, batch: int, kind: str) -> DataFrame:
        part = self._written(rows, batch, kind)
        self.log.commit(lambda state: [part])
        return self._read([part["path"]])

    def append(self, records: DataFrame, batch: int) -> DataFrame:
        """Provenance records of a batch, as they were written."""
        return self._add(records, batch, "record")

    def append_summary(self, summary: dict, batch: int) -> None:
        self._add(self._summaries([summary]), batch, "summary")

    def _summaries(self, summaries: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([(json.dumps(s),) for s in summaries], "body string").coalesce(1)

    def supersede(self, records: DataFrame, batch: int) -> None:
        """New decisions for earlier ones of the same doc_id; the earlier records stay."""
        self._add(records.withColumn("supersedes", F.col("doc_id").cast("string")), batch, "superseding")

    def advance(self, name: str, batch: int, value: dict, summaries: list[dict] | None = None, dropped: Iterable[tuple[str, int]] = ()) -> bool:
        """The state `name` after a batch, the batch's summaries, and parts (kind, batch) that are needed no more, in one commit.

        False, and nothing, if that batch or a later one was committed before.
        """
        part = self._written(self._summaries(summaries), batch, "summary") if summaries else None
        done = []

        def made(state: State) -> list[dict]:
            if name in state.states and state.states[name][0] >= batch:
                return []
            done.append(True)
            gone = [{"do": "drop", "writer": self.writer, "kind": k, "batch": b} for k, b in dropped]
            return [*([part] if part else []), *gone, {"do": "state", "name": name, "batch": batch, "value": value}]

        self.log.commit(made)
        return bool(done)

    def reached(self, name: str) -> tuple[int, dict] | None:
        """The last batch and state that advance() committed under a name."""
        return self.log.state().states.get(name)

    def stage(self, rows: DataFrame, kind: str, batch: int) -> None:
        """Rows of any columns, kept until advance() drops them."""
        path = self.log.folder()
        rows.write.parquet(path)
        self.log.commit(lambda state: [{"do": "part", "writer": self.writer, "kind": kind, "batch": batch, "path": path}])

    def staged(self, kind: str, schema) -> DataFrame:
        paths = [p for (w, k, _), p in self.log.state().parts.items() if (w, k) == (self.writer, kind)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def records(self, kind: str | None = None) -> DataFrame:
        return self._read([p for (_, k, _), p in self.log.state().parts.items() if k in KINDS and kind in (None, k)])

    def trace(self, doc_id: str) -> DataFrame:
        """All records of a document in order."""
        return self.records().where((F.col("doc_id") == str(doc_id)) & (F.col("kind") != "summary")).orderBy("batch", "seq")

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rows.columns), F.struct("batch", "seq")).alias("r")).select("r.*")

    def _current(self, state: State, upto: int | None) -> tuple[DataFrame, dict]:
        """The latest records, up to a batch if any, and the parts that they come from."""
        parts = {k: p for k, p in state.parts.items() if k[1] in KINDS[:2] and (upto is None or k[2] <= upto)}
        path, holds = state.compacted or (None, {})
        if path is None or not set(holds) <= set(parts):
            return self._latest(self._read(list(parts.values()))), parts
        new = [p for k, p in parts.items() if k not in holds]
        base = self._read([path])
        return (self._latest(base.unionByName(self._read(new))) if new else base), parts

    def current(self, upto: int | None = None) -> DataFrame:
        """The latest record of each document; with upto, as of that batch. Right after compact() it is read without a shuffle."""
        return self._current(self.log.state(), upto)[0]

    def compact(self) -> None:
        """Writes the latest records, which current() begins with from now on. The history stays for trace() and earlier batches."""
        rows, holds = self._current(self.log.state(), None)
        path = self.log.folder()
        rows.write.parquet(path)
        self.log.commit(lambda state: [{"do": "compact", "path": path, "holds": [[*k, p] for k, p in holds.items()]}])
