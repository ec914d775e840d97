"""A judge that is asked in batches, remembers its verdicts and goes on where it was stopped.

The judge itself is a function of the caller: a list of texts -> a list of verdicts (label, score, reason), None for each that failed. Verdicts
are kept by the hash of the text as parts of a commit log: rows of equal texts share one, later runs over the same texts ask nothing, and a
run that dies keeps what was committed. Texts are asked in shares of a bounded number, one commit each; what failed is asked again with a
later attempt, and what fails in all of them stays open, for a person.

A text is asked once, unless its answer fails or Spark runs a task again (a lost executor, a speculative copy): answers of a task that didn't
end aren't kept. limit bounds the calls of a run; texts beyond it stay open until the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut
from gatehouse.functions.order import ranked
from gatehouse.operators.cascade import FILTER, RETAIN, REVIEW
from gatehouse.sources.commits import CommitLog

VERDICTS = "key string, label int, score double, reason string"
#: A judge's answer to one text, None where it failed.
Verdict = tuple[int, float, str]
Ask = Callable[[list[str]], Sequence[Verdict | None]]


def _asked(ask: Ask, batch: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), batch):
                rows = part.iloc[lo : lo + batch]
                try:
                    got = list(ask(rows["text"].tolist()))
                except Exception:  # a call that fails as a whole is asked again like others
                    got = [None] * len(rows)
                done = [(k, int(v[0]), float(v[1]), str(v[2])) for k, v in zip(rows["key"], got, strict=False) if v is not None and int(v[0]) in (FILTER, REVIEW, RETAIN)]
                yield pd.DataFrame(done, columns=["key", "label", "score", "reason"])

    return run


class KeptJudge:
    """ask with memory, for curate(judge=...). path: where verdicts are kept. share: texts of a commit. batch: texts of a call. limit: calls of texts in one run, if any."""

    def __init__(self, spark: SparkSession, path: str, ask: Ask, attempts: int = 3, share: int = 100_000, batch: int = 16, limit: int | None = None, name: str = "judge"):
        self.spark, self.log, self.ask, self.name = spark, CommitLog(spark, path), ask, name
        self.attempts, self.share, self.batch, self.limit = attempts, share, batch, limit

    def verdicts(self) -> DataFrame:
        """key, label, score and reason of every text that was answered; of two answers to one text, which two runs at once may get, the lesser."""
        paths = list(self.log.state().parts.values())
        rows = self.spark.read.schema(VERDICTS).parquet(*paths) if paths else self.spark.createDataFrame([], VERDICTS)
        return rows.groupBy("key").agg(F.min(F.struct("label", "score", "reason")).alias("v")).select("key", "v.*")

    def _keep(self, answers: DataFrame) -> None:
        path = self.log.folder()
        answers.write.parquet(path)
        self.log.commit(lambda state: [{"do": "part", "writer": path, "kind": "verdicts", "batch": state.version + 1, "path": path}])

    def answer(self, rows: DataFrame) -> None:
        """Asks about the texts of rows that have no verdict yet."""
        texts = rows.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
        left = self.limit
        for _ in range(self.attempts):
            opened = cut(texts.join(self.verdicts().select("key"), "key", "left_anti"))
            n = opened.count() if left is None else min(opened.count(), left)
            if not n:
                return
            placed = cut(ranked(opened.select("key"), "key"))
            for lo in range(0, n, self.share):
                part = opened.join(placed.where(f"rank >= {lo} AND rank < {min(lo + self.share, n)}").select("key"), "key")
                self._keep(part.mapInPandas(_asked(self.ask, self.batch), VERDICTS))
            left = None if left is None else left - n

    def __call__(self, rows: DataFrame) -> DataFrame:
        """rows with label, score, stage, reasons and risk: the verdict, or review where there is none."""
        rows = cut(rows)
        self.answer(rows)
        kept = self.verdicts().withColumnsRenamed({"key": "_key", "label": "_label", "score": "_verdict", "reason": "_reason"})
        held = rows.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256)).join(kept, F.col("_text") == F.col("_key"), "left")
        there = F.col("_label").isNotNull()
        made = {
            "label": F.coalesce("_label", F.lit(REVIEW)), "score": F.coalesce("_verdict", F.lit(0.5)), "stage": F.when(there, self.name).otherwise(f"{self.name}-open"),
            "reasons": F.array(F.coalesce("_reason", F.lit("no verdict; escalated to human review"))), "risk": F.lit(0.0),
        }
        return held.withColumns(made).drop("_key", "_text", "_label", "_verdict", "_reason")
