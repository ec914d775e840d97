import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.functions import order


@pytest.mark.parametrize("inside", [3, 20_000])
def test_selected_equals_numpy(spark, monkeypatch, inside):
    monkeypatch.setattr(order, "INSIDE", inside)
    rng = random.Random(4)
    kinds = {"a": lambda: rng.gauss(0, 1), "b": lambda: float(rng.randint(0, 3)), "c": lambda: rng.choice([None, 1e9 * rng.random(), -1e-9]), "d": lambda: float(rng.random() < 0.5)}
    rows = [(g, *[k() for k in kinds.values()]) for g, n in (("hot", 4000), ("two", 2), ("one", 1), (None, 301)) for _ in range(n)] + [("void", None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double").repartition(7).persist()
    for share in (0.5, 0.999) if inside == 3 else (0.0, 0.25, 1.0):
        got = {(r["g"], r["feature"]): (r["n"], r["value"]) for r in order.selected(df, ["g"], list(kinds), share).collect()}
        want = {}
        for g in ("hot", "two", "one", None, "void"):
            for i, name in enumerate(kinds):
                xs = [r[1 + i] for r in rows if r[0] == g and r[1 + i] is not None]
                if xs:
                    want[g, name] = (len(xs), float(np.quantile(xs, share)))
        assert set(got) == set(want)
        assert all(got[k][0] == n and got[k][1] == pytest.approx(v, rel=1e-12, abs=1e-15) for k, (n, v) in want.items())
    assert order.selected(df.where("false"), ["g"], list(kinds)).count() == 0
    df.unpersist()


def test_a_bracket_that_misses_is_counted_anew(spark, monkeypatch):
    monkeypatch.setattr(order, "INSIDE", 5)
    made = order._narrower
    calls = []

    def wrong(at, share, margin):
        calls.append(margin)
        return F.struct(F.lit(1e6).alias("low"), F.lit(2e6).alias("high"), F.lit(True).alias("open")) if len(calls) == 1 else made(at, share, margin)

    monkeypatch.setattr(order, "_narrower", wrong)
    df = spark.range(1001).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"))
    assert order.selected(df, ["g"], ["x"]).first()["value"] == 500.0 and len(calls) > 2


def test_one_value_many_times(spark, monkeypatch):
    monkeypatch.setattr(order, "INSIDE", 10)
    df = spark.range(5000).select(F.when(F.col("id") < 2500, 1.0).otherwise(2.0).alias("x"), F.lit(1).alias("g"))
    assert order.selected(df, ["g"], ["x"]).first()["value"] == 1.5  # the ranks lie on two values of many rows each


@pytest.mark.parametrize("inside", [4, 20_000])
def test_bands_equal_ranks(spark, monkeypatch, inside):
    monkeypatch.setattr(order, "INSIDE", inside)
    rng = random.Random(2)
    rows = [(i, float(rng.choice([rng.randint(0, 4), rng.random() * 5]))) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(5)
    rank = {i: r for r, (i, x) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    for first, last in ((100, 101), (349, 520), (650, 900)) if inside == 4 else ((0, 700), (0, 0), (0, 1), (699, 700)):
        got = {r["id"]: r["band"] for r in order.banded(df, "x", first, last, "id").collect()}
        assert got == {i: -1 if r < first else 1 if r >= last else 0 for i, r in rank.items()}, (first, last)
    assert order.banded(df.where("false"), "x", 0, 3, "id").count() == 0


def test_selection_counts_bins_and_reads_few_times(spark, monkeypatch):
    """Sketches of each column and group in every task once took most of the time of the cohort statistics."""
    plans, cut = [], order.cut
    monkeypatch.setattr(order, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    df = cut(spark.range(400_000).select((F.col("id") % 2).alias("g"), F.log1p("id").alias("x"), (F.col("id") % 7 == 0).cast("double").alias("y")))
    got = {(r["g"], r["feature"]): r["value"] for r in order.selected(df, ["g"], ["x", "y"]).collect()}
    for g in (0, 1):
        assert got[g, "x"] == pytest.approx(float(np.median(np.log1p(np.arange(g, 400_000, 2)))), rel=1e-12) and got[g, "y"] == 0.0
    assert len(plans) <= 3 and not any("percentile" in p or "ObjectHashAggregate" in p for p in plans)


@pytest.mark.parametrize("inside", [3, 20_000])
def test_counted_values_in_several_rows_add_up(spark, monkeypatch, inside):
    """Days of a window were once added up by value and dealt out in order for each version."""
    monkeypatch.setattr(order, "INSIDE", inside)
    rng = random.Random(9)
    odd = [float("-inf"), -1e308, -2.5e-310, -0.0, 0.0, 5e-324, 1e308, float("inf"), float("nan")]
    rows = [(g, rng.choice(odd) if g == "odd" else round(rng.gauss(0, 9), 1), rng.randint(1, 5)) for g in ("a", None, "odd") for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, value double, n long").repartition(5).persist()
    for share in (0.0, 0.31, 0.5, 1.0):
        got = {r["g"]: (r["n"], r["value"]) for r in order.selected_counts(df, ["g"], share).collect()}
        for g in ("a", None, "odd"):
            xs = np.sort(np.repeat([v for h, v, _ in rows if h == g], [n for h, _, n in rows if h == g]))
            place = share * (len(xs) - 1)
            low, high = xs[int(np.floor(place))], xs[int(np.ceil(place))]
            assert got[g] == (len(xs), pytest.approx(low + (high - low) * (place - np.floor(place)), rel=1e-12, nan_ok=True)), (g, share)
    df.unpersist()
