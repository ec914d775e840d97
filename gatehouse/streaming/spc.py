"""Control charts for daily streams: EWMA and CUSUM, as a batch fold and as a stateful stream."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gatehouse.checkpoints import cut
from gatehouse.functions.joins import counted_join
from gatehouse.functions.order import ranked
from gatehouse.functions.stats import NORMAL, median


@dataclass(frozen=True)
class Chart:
    """alpha and limit of the EWMA; slack and limit of the CUSUM in sigmas; the watched direction: two_sided, down or up."""

    alpha: float = 0.2
    limit: float = 3.0
    slack: float = 0.5
    decision: float = 4.0
    watch: str = "two_sided"

    def step(self, state: tuple, x: float, mu: float, sigma: float) -> tuple:
        """state (z, up, down, t) after x."""
        z, up, down, t = state
        k = self.slack * sigma
        return self.alpha * x + (1 - self.alpha) * z, max(0.0, up + (x - mu - k)), max(0.0, down - (x - mu + k)), t + 1

    def alarms(self, state: tuple, mu: float, sigma: float) -> tuple[bool, bool, str]:
        z, up, down, t = state
        dev, h = z - mu, self.decision * sigma
        width = sigma * math.sqrt(self.alpha / (2 - self.alpha) * (1 - (1 - self.alpha) ** (2 * t)))
        ewma, cusum = abs(dev) > self.limit * width, up > h or down > h
        direction = "down" if dev < 0 or down > h else "up" if dev > 0 or up > h else "none"
        if self.watch == "down":
            ewma, cusum = ewma and dev < 0, down > h
        elif self.watch == "up":
            ewma, cusum = ewma and dev > 0, up > h
        return ewma, cusum, direction


def fit(baseline: DataFrame) -> DataFrame:
    """stream, mu, sigma from the warm-up rows (stream, day, value): the median, and the scaled MAD with a floor of 2 %."""
    mu = baseline.groupBy("stream").agg(median(F.col("value")).alias("mu"))
    dev = baseline.join(mu, "stream").groupBy("stream", "mu").agg(median(F.abs(F.col("value") - F.col("mu"))).alias("mad"))
    return dev.select("stream", "mu", F.greatest(F.lit(1e-9), F.lit(NORMAL) * F.col("mad"), F.lit(0.02) * (F.abs("mu") + F.lit(1e-6))).alias("sigma"))


def monitor(series: DataFrame, warmup: int, chart: Chart | None = None) -> DataFrame:
    """A row for each day after a stream's first `warmup` days: ewma, cusum_pos, cusum_neg, ewma_alarm, cusum_alarm, direction.

    series: stream, day, value, one row for each day. A stream's days (not its events) are folded in one row.
    """
    c = chart or Chart()
    days = series.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("days"))
    base = days.select("stream", F.explode(F.slice("days", 1, warmup)).alias("d")).select("stream", "d.day", "d.value")
    rest = days.join(fit(base), "stream").withColumn("rest", F.slice("days", F.lit(warmup + 1), F.greatest(F.size("days"), F.lit(1))))
    zero = F.struct(F.col("mu").alias("z"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<struct<day:int,value:double,z:double,up:double,down:double>>").alias("out"))
    mu, k = F.col("mu"), F.lit(c.slack) * F.col("sigma")

    def step(s, d):
        x = d["value"]
        z = F.lit(c.alpha) * x + F.lit(1 - c.alpha) * s["z"]
        up, down = F.greatest(F.lit(0.0), s["up"] + (x - mu - k)), F.greatest(F.lit(0.0), s["down"] - (x - mu + k))
        made = F.struct(d["day"].cast("int").alias("day"), x.cast("double").alias("value"), z.alias("z"), up.alias("up"), down.alias("down"))
        return F.struct(z.alias("z"), up.alias("up"), down.alias("down"), F.concat(s["out"], F.array(made)).alias("out"))

    rows = rest.select("stream", "mu", "sigma", F.posexplode(F.aggregate("rest", zero, step, lambda s: s["out"])).alias("i", "d")).select("stream", "mu", "sigma", (F.col("i") + 1).alias("t"), "d.*")
    return _decided(rows, c)


def _decided(rows: DataFrame, c: Chart) -> DataFrame:
    """stream, day, value, charts and alarms of rows with mu, sigma, t and the charts z, up, down."""
    dev, h = F.col("z") - F.col("mu"), F.lit(c.decision) * F.col("sigma")
    width = F.col("sigma") * F.sqrt(F.lit(c.alpha / (2 - c.alpha)) * (1 - F.pow(F.lit(1 - c.alpha), 2 * F.col("t"))))
    ewma, cusum = F.abs(dev) > c.limit * width, (F.col("up") > h) | (F.col("down") > h)
    if c.watch == "down":
        ewma, cusum = ewma & (dev < 0), F.col("down") > h
    elif c.watch == "up":
        ewma, cusum = ewma & (dev > 0), F.col("up") > h
    direction = F.when((dev < 0) | (F.col("down") > h), "down").when((dev > 0) | (F.col("up") > h), "up").otherwise("none")
    return rows.select("stream", "day", "value", F.col("z").alias("ewma"), F.col("up").alias("cusum_pos"), F.col("down").alias("cusum_neg"), ewma.alias("ewma_alarm"), cusum.alias("cusum_alarm"), direction.alias("direction"))


#: Points of a block of a long series at most.
BLOCK = 4096


def _carried(blocks: pd.DataFrame) -> pd.DataFrame:
    """What each block of a stream begins with. blocks: stream, b, z and keep (the mean's own part, and what it leaves of the one before), sums and their least prefixes."""
    blocks = blocks.sort_values("b")
    z, up, down, out = float(blocks["mu"].iloc[0]), 0.0, 0.0, []
    for r in blocks.itertuples(index=False):
        out.append((r.stream, r.b, z, up, down))
        z, up, down = r.z + r.keep * z, max(up + r.up, r.up - r.up_least), max(down + r.down, r.down - r.down_least)
    return pd.DataFrame(out, columns=["stream", "b", "z_in", "up_in", "down_in"])


def scan(series: DataFrame, warmup: int, chart: Chart | None = None, block: int = BLOCK) -> DataFrame:
    """monitor() for series of any length, as a scan: points are numbered over ranges, charts are made within blocks of points as if each were
    the first, blocks are summed up, and a block's points get what the blocks before it leave.

    EWMA: a block turns z into own + keep ** length * z. CUSUM: S after prefix sum C is the larger of S before the block + C, and C less its least
    prefix so far. Both are associative, so a block is a row, and a stream's blocks, one row for some thousand points, pass through one task.
    Powers of keep stay finite by the length of a block. day: any type with an order; equal days are ordered by value.
    """
    c = chart or Chart()
    keep = 1 - c.alpha
    size = max(1, min(block, int(250 / -math.log10(keep)) if 0 < keep < 1 else block))
    rows = ranked(series.select("stream", "day", F.col("value").cast("double").alias("value")).where("stream IS NOT NULL"), "stream", "day", "value")
    rows = cut(rows)
    streams = cut(rows.groupBy("stream").agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_k")))
    numbered = counted_join(rows, streams, "stream", "_k").withColumn("t", F.col("rank") - F.col("_first") - warmup + 1).drop("rank", "_first", "_k")
    fitted = fit(numbered.where("t <= 0"))
    rest = cut(counted_join(numbered.where("t > 0"), cut(streams.join(fitted, "stream").select("stream", "_k", "mu", "sigma")), "stream", "_k").drop("_k"))
    place = F.col("t") - 1
    rest = rest.withColumns({"b": F.floor(place / size), "i": F.pmod(place, F.lit(size)) + 1, "_up": F.col("value") - F.col("mu") - c.slack * F.col("sigma"), "_down": F.col("mu") - c.slack * F.col("sigma") - F.col("value")})
    upto = W.partitionBy("stream", "b").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    weighed = F.lit(c.alpha) * F.pow(F.lit(keep), F.col("i")) * F.sum(F.col("value") * F.pow(F.lit(keep), -F.col("i"))).over(upto) if keep > 0 else F.col("value")
    own = rest.withColumns({"_z": weighed, "_u": F.sum("_up").over(upto), "_d": F.sum("_down").over(upto)}).withColumns({"_ul": F.min("_u").over(upto), "_dl": F.min("_d").over(upto), "_keep": F.pow(F.lit(keep), F.col("i"))})
    own = cut(own)
    last = lambda x: F.max_by(x, "i")
    blocks = own.groupBy("stream", "b").agg(F.first("mu").alias("mu"), *[last(x).alias(n) for x, n in (("_z", "z"), ("_keep", "keep"), ("_u", "up"), ("_ul", "up_least"), ("_d", "down"), ("_dl", "down_least"))])
    carried = blocks.groupBy("stream").applyInPandas(_carried, "stream string, b long, z_in double, up_in double, down_in double")
    z = F.col("_z") + F.col("_keep") * F.col("z_in")
    over = lambda s, x, least: F.greatest(F.col(s) + F.col(x), F.col(x) - F.col(least))
    made = own.join(carried, ["stream", "b"]).withColumns({"z": z, "up": over("up_in", "_u", "_ul"), "down": over("down_in", "_d", "_dl")})
    return _decided(made, c)


OUT = "stream string, day int, value double, ewma double, cusum_pos double, cusum_neg double, ewma_alarm boolean, cusum_alarm boolean, direction string"


class ChartProcessor(StatefulProcessor):
    """Keeps, by stream, the warm-up values and then the chart's state. Whole days arrive in order; within a batch they are sorted."""

    def __init__(self, warmup: int, chart: Chart | None = None):
        self.warmup, self.chart = warmup, chart or Chart()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chart", "seen array<double>, mu double, sigma double, z double, up double, down double, t int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("day")
        seen, mu, sigma, z, up, down, t = self.state.get() if self.state.exists() else ([], 0.0, 0.0, 0.0, 0.0, 0.0, 0)
        seen, out = list(seen), []
        for day, x in zip(days["day"], days["value"], strict=True):
            if len(seen) < self.warmup:
                seen.append(float(x))
                if len(seen) == self.warmup:
                    s = pd.Series(seen)
                    mu = z = float(s.median())
                    sigma = max(1e-9, NORMAL * float((s - mu).abs().median()), 0.02 * (abs(mu) + 1e-6))
                continue
            z, up, down, t = self.chart.step((z, up, down, t), float(x), mu, sigma)
            out.append((key[0], int(day), float(x), z, up, down, *self.chart.alarms((z, up, down, t), mu, sigma)))
        self.state.update((seen, mu, sigma, z, up, down, t))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def monitor_stream(days: DataFrame, warmup: int, chart: Chart | None = None) -> DataFrame:
    """The chart over a streaming DataFrame of finished days (stream, day, value). Needs the RocksDB state store."""
    return days.groupBy("stream").transformWithStateInPandas(statefulProcessor=ChartProcessor(warmup, chart), outputStructType=OUT, outputMode="Append", timeMode="None")


def daily(events: DataFrame, ts: str = "ts", stream: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts and mean values by stream and day. On a stream, days close once the watermark passes them."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, "1 day").alias("w"), F.col(stream).alias("stream")).agg(F.count(F.lit(1)).cast("double").alias("throughput"), F.avg("value").alias("mean_value")).select("stream", F.to_date("w.start").alias("date"), "throughput", "mean_value")
