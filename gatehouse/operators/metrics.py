"""Evaluation against labels, each as one aggregation of conditional sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut
from gatehouse.functions.order import ranked
from gatehouse.functions.text import share


#: Shares of the documents that go to the judge.
FRACTIONS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)


def hits(test: Column) -> Column:
    return F.coalesce(F.sum(test.cast("int")), F.lit(0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    return share(2 * p * r, p + r)


def agreement(pred: Column, gold: Column) -> Column:
    return F.coalesce(F.avg((pred == gold).cast("double")), F.lit(0.0))


def macro_f1(pred: Column, gold: Column, classes: Sequence[int] = (0, 1, 2)) -> Column:
    """Unweighted over all classes; one that never occurs counts 0."""
    each = [f1(hits((pred == c) & (gold == c)), hits((pred == c) & (gold != c)), hits((pred != c) & (gold == c))) for c in classes]
    return sum(each[1:], each[0]) / len(each)


def binary_prf(pred: Column, gold: Column) -> dict[str, Column]:
    tp, fp, fn = hits((pred == 1) & (gold == 1)), hits((pred == 1) & (gold == 0)), hits((pred == 0) & (gold == 1))
    return {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": f1(tp, fp, fn)}


def budget_curve(judged: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Macro-F1 when a share of documents, centred in the score order, goes to the judge. judged: doc_id, score, judge_label, gold.

    Documents below that band are filtered, above it retained. Ranks are by (score, doc_id), over ranges, so that neither a task nor a score
    that many documents have holds them all.
    """
    spark = judged.sparkSession
    judged = cut(judged)
    n = judged.count()
    ordered = ranked(judged, "score", "doc_id")
    # k is frac * n rounded half to even, as the driver rounds it
    bands = spark.createDataFrame([(float(f), (n - round(f * n)) // 2, (n - round(f * n)) // 2 + round(f * n)) for f in fractions], "fraction double, low long, high long")
    routed = ordered.crossJoin(F.broadcast(bands)).withColumn("pred", F.when(F.col("rank") < F.col("low"), 0).when(F.col("rank") >= F.col("high"), 2).otherwise(F.col("judge_label")))
    return routed.groupBy("fraction").agg(macro_f1(F.col("pred"), F.col("gold")).alias("macro_f1"), agreement(F.col("pred"), F.col("gold")).alias("agreement"), hits((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).alias("judge_calls"))
