"""Cohort outliers by robust z over the text profile.

A document is held against its cohort's median and MAD, or the pooled ones if its cohort was unseen or is smaller than min_cohort. Medians are
exact and made of counted bins of values, so that neither a hot cohort nor the pooled one meets in a task. The statistics are a small table
(cohorts x features) that can be kept and reused as a reference window; documents are scored row by row, without a shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut
from gatehouse.functions import lexicon as X
from gatehouse.functions.order import selected, selected_counts
from gatehouse.functions.stats import robust_z, std

Z, MIN_COHORT = 3.5, 12
#: So many rows of statistics, or cohorts, are broadcast; more are joined by key.
SMALL = 50_000
_GROUP = ("pooled", "source", "feature")


def counted(features: DataFrame, names: Sequence[str] = X.FEATURES) -> DataFrame:
    """source, feature, value, n: how often each value occurs in a cohort."""
    return features.unpivot(["source"], list(names), "feature", "value").groupBy("source", "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _cohorts(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every row in its own cohort and in the pooled one: source is null there."""
    rows = features.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("pooled"), "source", *[F.col(n).cast("double").alias(n) for n in names])
    return rows.withColumn("source", F.when(~F.col("pooled"), F.col("source")))


def fit(features: DataFrame, names: Sequence[str] = X.FEATURES) -> DataFrame:
    """source (null: none, or pooled), pooled, feature, n, med, mad. The features are made once; see order.selected for the medians."""
    rows = _cohorts(cut(features.select("source", *names)), names)
    meds = cut(selected(rows, ("pooled", "source"), names)).withColumnRenamed("value", "med")
    wide = meds.groupBy("pooled", "source").agg(*[F.max(F.when(F.col("feature") == n, F.col("med"))).alias(f"_m_{n}") for n in names])
    m = _small(wide.withColumnsRenamed({"pooled": "_pooled", "source": "_source"}))
    held = rows.join(m, (F.col("pooled") == F.col("_pooled")) & F.col("source").eqNullSafe(F.col("_source")))
    away = held.select("pooled", "source", *[F.abs(F.col(n) - F.col(f"_m_{n}")).alias(n) for n in names])
    mads = selected(away, ("pooled", "source"), names).select(*[F.col(k).alias(f"_{k}") for k in _GROUP], F.col("value").alias("mad"))
    same = (meds["pooled"] == F.col("_pooled")) & meds["source"].eqNullSafe(F.col("_source")) & (meds["feature"] == F.col("_feature"))
    return meds.join(mads, same).select(*_GROUP, "n", "med", "mad")


def fit_counts(counts: DataFrame) -> DataFrame:
    """The same from counted values (source, feature, value, n), which add up over any parts of a corpus. They are read a few times."""
    both = counts.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("pooled"), "source", "feature", F.col("value").cast("double").alias("value"), "n")
    both = both.withColumn("source", F.when(~F.col("pooled"), F.col("source")))
    meds = cut(selected_counts(both, _GROUP)).withColumnRenamed("value", "med")
    m = _small(meds.select(*[F.col(k).alias(f"_{k}") for k in _GROUP], "med"))
    held = both.join(m, (F.col("pooled") == F.col("_pooled")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("feature") == F.col("_feature")))
    mads = selected_counts(held.select(*_GROUP, F.abs(F.col("value") - F.col("med")).alias("value"), "n"), _GROUP).select(*[F.col(k).alias(f"_{k}") for k in _GROUP], F.col("value").alias("mad"))
    same = (meds["pooled"] == F.col("_pooled")) & meds["source"].eqNullSafe(F.col("_source")) & (meds["feature"] == F.col("_feature"))
    return meds.join(mads, same).select(*_GROUP, "n", "med", "mad")


def _by_feature(names: Sequence[str]) -> Column:
    """The statistics of a group as an array in the order of names, null where there are none."""
    return F.array(*[F.max(F.when(F.col("feature") == n, F.struct("n", "med", "mad"))) for n in names])


def score(features: DataFrame, stats: DataFrame, z: float = Z, min_cohort: int = MIN_COHORT, names: Sequence[str] = X.FEATURES) -> DataFrame:
    """doc_id, source, outlier_flags (in feature order), outlier_score (largest |z| of those flagged, else 0), is_outlier, for every row."""
    own = _small(stats.where(~F.col("pooled")).groupBy(F.col("source").alias("_source")).agg(_by_feature(names).alias("_own")))
    pool = stats.where("pooled").agg(_by_feature(names).alias("_pool"))  # one row
    values = features.select("doc_id", "source", F.array(*[F.col(n).cast("double") for n in names]).alias("_x"))
    held = values.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").crossJoin(F.broadcast(pool))

    def one(x: Column, i: Column) -> Column:
        a, p = F.get("_own", i), F.get("_pool", i)
        few = F.coalesce(a["n"], F.lit(0)) < min_cohort
        use = lambda k: F.when(few, p[k]).otherwise(a[k])
        return F.struct(F.abs(robust_z(x, use("med"), use("mad"))).alias("z"), F.get(F.array(*map(F.lit, names)), i).alias("name"))

    hit = held.select("doc_id", "source", F.filter(F.transform("_x", one), lambda h: h["z"] >= z).alias("_hit"))
    return hit.select("doc_id", "source", F.transform("_hit", lambda h: h["name"]).alias("outlier_flags"), F.coalesce(F.array_max(F.transform("_hit", lambda h: h["z"])), F.lit(0.0)).alias("outlier_score"), (F.size("_hit") > 0).alias("is_outlier"))


def profile(features: DataFrame, z: float = Z, min_cohort: int = MIN_COHORT, names: Sequence[str] = X.FEATURES) -> DataFrame:
    """Fit and score on one corpus, whose features are made once."""
    features = cut(features.select("doc_id", "source", *names))
    return score(features, fit(features, names), z, min_cohort, names)


def k_sigma(features: DataFrame, z: float = Z, names: Sequence[str] = X.FEATURES) -> DataFrame:
    """doc_id and whether any feature with a deviation above 1e-9 is z deviations from the mean: the control detector, for every row."""
    features = cut(features.select("doc_id", *names))
    one = features.agg(*[F.struct(F.avg(n).alias("mean"), std(F.col(n)).alias("sd")).alias(f"_{n}") for n in names])
    hit = F.lit(False)
    for n in names:
        s = F.col(f"_{n}")
        hit = hit | F.coalesce((s["sd"] > 1e-9) & (F.abs(F.col(n) - s["mean"]) / s["sd"] >= z), F.lit(False))
    return features.crossJoin(F.broadcast(one)).select("doc_id", hit.alias("is_outlier"))  # one row
