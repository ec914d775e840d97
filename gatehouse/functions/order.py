"""Ranks and exact quantiles of any number of rows, of which no task holds a group.

ranked and quantiles deal rows, or counted values, to ranges in order and place ranges by their counts. selected finds quantiles of many
columns and groups at once without a shuffle of the rows: a pass counts bins of values, the next one parts the bin that holds the quantile, and
only what lies in the last, small bins is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut, partitions

#: Rows that a range holds at most, about.
RANGE_ROWS = 1_000_000
#: Rows in a bin that are few enough to be sorted, for each group and column.
INSIDE = 20_000
#: Bins for each power of two, in a first pass; equal parts of a bin, in later ones; how often counts that don't agree are begun anew.
OCTAVE, PARTS, AGAIN = 8, 1024, 3


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with every row's place, from 0, in the order of the columns named."""
    n = max(partitions(df.sparkSession), -(-df.count() // RANGE_ROWS))
    parts = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = parts.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_r")) - F.col("_n"))  # a row for each range
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), parts["_range"] == before["_r"]).withColumn(name, F.col("_before") + own).drop("_range", "_r", "_n", "_before")


def tallied(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """keys, value, n: how often each value occurs in a group. Nulls don't count."""
    return df.select(*keys, value.cast("double").alias("value")).where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(tally: DataFrame, keys: Sequence[str], **shares: float) -> DataFrame:
    """keys, n and a column for each named share: the exact quantile, linear between neighbours. tally: as of tallied()."""
    n = partitions(tally.sparkSession)
    parts = cut(tally.repartitionByRange(n, *keys, "value").withColumn("_range", F.spark_partition_id()))
    at = [*keys, "_range"]
    sizes = parts.groupBy(*at).agg(F.sum("n").alias("_n"))
    group = W.partitionBy(*keys)
    before = sizes.withColumns({"_before": F.sum("_n").over(group.orderBy("_range")) - F.col("_n"), "_all": F.sum("_n").over(group)}).drop("_n")
    before = before.select(*[F.col(k).alias(f"_{k}") for k in at], "_before", "_all")
    rows = parts.join(before, _same(parts, before, at)).withColumn("_to", F.col("_before") + F.sum("n").over(W.partitionBy(*at).orderBy("value")))
    made = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_all") - 1)
        held = lambda r: F.max(F.when((F.col("_to") > r) & (F.col("_to") - F.col("n") <= r), F.col("value")))
        low, high = held(F.floor(place)), held(F.ceil(place))
        made.append((low + (high - low) * F.first(place - F.floor(place))).alias(name))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *made)


def _joined(values: DataFrame, state: DataFrame, keys: Sequence[str], small: int) -> DataFrame:
    """values joined to brackets, which are broadcast if they are few."""
    made = state.withColumnsRenamed({k: f"_{k}" for k in keys})
    made = F.broadcast(made) if made.limit(small + 1).count() <= small else made
    return values.join(made, _same(values, made, keys)).drop(*[f"_{k}" for k in keys])


def _place(n: Column, share: float | Callable[[Column], Column]) -> Column:
    return share(n) if callable(share) else F.lit(float(share)) * (n - 1)


def _octave(x: Column) -> Column:
    """A number that grows with x, OCTAVE for each power of two; NaN is the largest."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * OCTAVE) + F.lit(2000 * OCTAVE)
    return F.when(F.isnan(x), F.lit(4000 * OCTAVE)).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("int")


def _part(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.floor((x - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("int")


def _binned(values: DataFrame, keys: Sequence[str], part: Column, *known: str) -> DataFrame:
    """keys and at: n, and the bins that hold the two ranks next to the quantile's place, each with its ends, its size and how many values lie below."""
    bins = values.groupBy(*keys, *known, part.alias("_part")).agg(F.sum("_k").alias("k"), F.min("value").alias("low"), F.max("value").alias("high"))
    group = W.partitionBy(*keys)
    inside = F.sum("k").over(group)
    n, before = (F.col("_n"), F.col("_before")) if known else (inside, F.lit(0))
    return bins.withColumns({"n": n, "inside": inside, "before": before + F.sum("k").over(group.orderBy("_part")) - F.col("k")})


def _at(bins: DataFrame, keys: Sequence[str], share: float | Callable[[Column], Column]) -> DataFrame:
    place = _place(F.col("n"), share)
    bin_of = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("k")), F.struct("before", "k", "low", "high")))
    held = bins.groupBy(*keys).agg(F.first("n").alias("n"), F.first("inside").alias("inside"), bin_of(F.floor(place)).alias("a"), bin_of(F.ceil(place)).alias("b"))
    return held.select(*keys, F.struct("n", "inside", "a", "b").alias("at"))


def _narrower(at: Column, share: float | Callable[[Column], Column], inside: int) -> Column:
    """The next bracket: the ends of the bin that holds both ranks, open if it has to be parted again. Ranks in two bins are the last and the first value there."""
    one = at["a"]["before"] == at["b"]["before"]
    low, high = F.when(one, at["a"]["low"]).otherwise(at["a"]["high"]), F.when(one, at["a"]["high"]).otherwise(at["b"]["low"])
    return F.struct(low.alias("low"), high.alias("high"), (one & (low < high) & (at["a"]["k"] > inside)).alias("open"))


def _brackets(held: DataFrame, keys: Sequence[str], share: float | Callable[[Column], Column]) -> DataFrame:
    """keys, n, before, k, low, high, open, and few: whether what lies inside is to be sorted."""
    at = F.col("at")
    made = held.withColumn("to", _narrower(at, share, INSIDE))
    one = (at["a"]["before"] == at["b"]["before"]) & (F.col("to.low") < F.col("to.high")) & ~F.col("to.open")
    return made.select(*keys, at["n"].alias("n"), at["a"]["before"].alias("before"), at["a"]["k"].alias("k"), "to.*", one.alias("few"))


def selected_counts(values: DataFrame, keys: Sequence[str], share: float | Callable[[Column], Column] = 0.5, count: str = "n", small: int = 50_000) -> DataFrame:
    """keys, n, value: the exact quantile of each group of counted values (keys, value, count), linear between neighbours; nulls don't count.

    A value may be in several rows. values is read a few times, so it should be a table or a checkpoint. Each pass counts bins, first by powers of two, then equal parts of the one bin that
    holds the quantile, and shuffles a row for each bin and task; the ends of a bin are values that were seen. Once INSIDE are left in it they are sorted. A bin in which a later pass finds
    other values than were counted is counted anew. NaN and infinities take part as the largest and outermost values.
    """
    x = F.col("value")
    values = values.select(*keys, x.cast("double").alias("value"), F.col(count).alias("_k")).where("value IS NOT NULL")
    whole = lambda: cut(_brackets(_at(_binned(values, keys, _octave(x)), keys, share), keys, share))
    state, again = whole(), 0
    while state.where("open").limit(1).count():
        held = _joined(values, state.where("open").select(*keys, F.col("n").alias("_n"), F.col("before").alias("_before"), F.col("k").alias("_all"), F.col("low").alias("_low"), F.col("high").alias("_high")), keys, small)
        bins = _binned(held.where("value BETWEEN _low AND _high"), keys, _part(x, F.col("_low"), F.col("_high")), "_n", "_before", "_low", "_high")
        parted = cut(_at(bins, keys, share))
        expected = state.where("open").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("k").alias("_expected"))
        wrong = expected.join(parted, _same(parted, expected, keys), "left").where("NOT (at.inside <=> _expected) OR at.a IS NULL OR at.b IS NULL")
        if wrong.limit(1).count():
            again += 1
            if again > AGAIN:
                raise RuntimeError("the values aren't the same each time they are read")
            state = whole()
            continue
        state = cut(state.where("NOT open").unionByName(_brackets(parted, keys, share)))
    frac = _place(F.col("n"), share)
    between = lambda low, high: (low + (high - low) * (frac - F.floor(frac))).alias("value")
    known = state.where("NOT few").select(*keys, "n", between(F.col("low"), F.col("high")))
    inner = _joined(values, state.where("few").select(*keys, "n", F.col("before").alias("_before"), F.col("low").alias("_low"), F.col("high").alias("_high")), keys, small)
    inner = inner.where("value BETWEEN _low AND _high").groupBy(*keys, "n", "_before", "value").agg(F.sum("_k").alias("_k"))
    inner = inner.withColumn("_to", F.col("_before") + F.sum("_k").over(W.partitionBy(*keys).orderBy("value")))
    at = lambda r: F.max(F.when((F.col("_to") > r) & (F.col("_to") - F.col("_k") <= r), x))
    ends = inner.groupBy(*keys, "n").agg(at(F.floor(frac)).alias("low"), at(F.ceil(frac)).alias("high"))
    return known.unionByName(ends.select(*keys, "n", between(F.col("low"), F.col("high"))))


def selected(df: DataFrame, keys: Sequence[str], names: Sequence[str], share: float | Callable[[Column], Column] = 0.5, small: int = 50_000) -> DataFrame:
    """keys, feature, n, value: the exact quantile of each named column in each group, as of selected_counts(); share may be a function that makes a rank, from 0, of n."""
    values = df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(keys), list(names), "feature", "value").withColumn("n", F.lit(1).cast("long"))
    return selected_counts(values, [*keys, "feature"], share, small=small)


def banded(df: DataFrame, value: str, first: int, last: int, *ties: str, name: str = "band") -> DataFrame:
    """df with -1, 0 or 1 for rows before, within and after the ranks first <= r < last in the order of (value, *ties), without a sort of df.

    The values at both ends are selected; only rows that have one of these two are ranked among themselves. value: a double, not null.
    """
    df = cut(df)
    n = df.count()
    first, last = max(0, min(first, n)), max(0, min(last, n))
    if not n or first >= last:
        return ranked(df, value, *ties, name=name).withColumn(name, F.when(F.col(name) < first, -1).otherwise(1)) if n else df.withColumn(name, F.lit(0))
    one = df.select(F.lit(0).alias("g"), F.col(value).cast("double").alias("x"))
    ends = [selected(one, ["g"], ["x"], lambda n, r=r: F.lit(r)).first()["value"] for r in (first, last - 1)]
    x, (low, high) = F.col(value), ends
    inner = df.where(~x.isin(low, high)).withColumn(name, F.when(x < low, -1).when(x > high, 1).otherwise(0))
    for end in sorted({low, high}):
        before = df.where(x < end).count()
        placed = ranked(df.where(x == end), *(ties or (value,)), name=name)
        rank = F.col(name) + before
        inner = inner.unionByName(placed.withColumn(name, F.when(rank < first, -1).when(rank >= last, 1).otherwise(0)))
    return inner
