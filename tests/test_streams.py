import random
import statistics

import pytest
from pyspark.sql import functions as F

from gatehouse.operators import mutate
from gatehouse.sources import adapters
from gatehouse.sources.ledger import Ledger
from gatehouse.streaming import routine, spc

SERIES = [0.9 + 0.01 * (i % 3) for i in range(15)] + [0.5] * 5


def plain(values, warmup, chart):
    base = values[:warmup]
    mu = statistics.median(base)
    sigma = max(1e-9, 1.4826 * statistics.median([abs(v - mu) for v in base]), 0.02 * (abs(mu) + 1e-6))
    state, out = (mu, 0.0, 0.0, 0), []
    for x in values[warmup:]:
        state = chart.step(state, x, mu, sigma)
        out.append((*state[:3], *chart.alarms(state, mu, sigma)))
    return out


def frame(spark):
    return spark.createDataFrame([("s", d, v) for d, v in enumerate(SERIES)] + [("t", d, 1.0) for d in range(20)], "stream string, day int, value double")


@pytest.mark.parametrize("watch", ["two_sided", "down", "up"])
def test_batch_fold_equals_the_recursion(spark, watch):
    chart = spc.Chart(watch=watch)
    got = spc.monitor(frame(spark), 10, chart).where("stream = 's'").orderBy("day").collect()
    want = plain(SERIES, 10, chart)
    assert [r["day"] for r in got] == list(range(10, 20))
    for r, w in zip(got, want, strict=True):
        assert [r["ewma"], r["cusum_pos"], r["cusum_neg"]] == pytest.approx(w[:3]) and (r["ewma_alarm"], r["cusum_alarm"], r["direction"]) == w[3:]
    assert any(r["ewma_alarm"] for r in got) == (watch != "up")


@pytest.mark.parametrize(("watch", "alpha", "block"), [("two_sided", 0.2, 4096), ("up", 0.2, 7), ("down", 1.0, 50), ("two_sided", 0.9, 4096)])
def test_scan_equals_the_recursion(spark, watch, alpha, block):
    rng = random.Random(3)
    chart = spc.Chart(alpha=alpha, watch=watch)
    series = {"hot": [rng.gauss(10, 2) + (k > 3000) * 3 for k in range(5000)], "few": [rng.random() for _ in range(30)], "short": [1.0, 2.0], "flat": [4.0] * 60}
    df = spark.createDataFrame([(s, k, x) for s, xs in series.items() for k, x in enumerate(xs)], "stream string, day int, value double").repartition(6)
    got = {}
    for r in spc.scan(df, 20, chart, block).collect():
        got.setdefault(r["stream"], []).append(r)
    assert set(got) == {"hot", "few", "flat"}
    for s, rows in got.items():
        rows.sort(key=lambda r: r["day"])
        want = plain(series[s], 20, chart)
        assert [r["day"] for r in rows] == list(range(20, len(series[s])))
        for r, w in zip(rows, want, strict=True):
            assert [r["ewma"], r["cusum_pos"], r["cusum_neg"]] == pytest.approx(w[:3], rel=1e-9, abs=1e-9) and (r["ewma_alarm"], r["cusum_alarm"]) == w[3:5]
            assert r["direction"] == w[5] or s == "flat"


def test_stream_equals_batch(spark, tmp_path):
    rows = frame(spark)
    for k, (a, b) in enumerate(((0, 7), (7, 14), (14, 20))):  # whole days, in order
        rows.where((F.col("day") >= a) & (F.col("day") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    days = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = spc.monitor_stream(days, 10).writeStream.format("memory").queryName("charted").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    key = lambda df: sorted((r["stream"], r["day"], round(r["ewma"], 9), round(r["cusum_neg"], 9), r["ewma_alarm"]) for r in df.collect())
    assert key(spark.table("charted")) == key(spc.monitor(rows, 10))


def test_reextract(spark):
    text = "<p>Short</p>\nA whole sentence stays.\nmenu item\nThis line has no closing mark but is long enough https://x.y/z"
    assert spark.range(1).select(routine.simple_reextract(F.lit(text)).alias("t")).first()["t"] == "A whole sentence stays. This line has no closing mark but is long enough "


def test_routine_alarms_remediates_and_recovers(spark):
    docs = adapters.clean_corpus(spark, 12, 7, ("html",)).persist()
    bad = docs.withColumn("text", mutate.script_style(F.col("text"), 0, F.col("doc_id"), "heldout"))
    loop, harness = routine.Routine(warmup=3, remediator=lambda d: docs), routine.LocalHarness()
    out = [loop.tick(harness, bad if day == 4 else docs) for day in range(6)]
    assert [o["ok"] for o in out[:4]] == [True] * 4
    assert "quality_drift_down" in out[4]["alerts"] and out[4]["actions"] == ["hillclimb"] and "recovered" in out[5]["actions"] and len(harness.summaries) == 6
    docs.unpersist()


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def day_files(spark, tmp_path_factory):
    """Six days in files of their own: defects on the fifth; a document of day 1 comes with day 3."""
    docs = adapters.clean_corpus(spark, 6, 7, ("html",)).persist()
    bad = docs.withColumn("text", mutate.script_style(F.col("text"), 0, F.col("doc_id"), "heldout"))
    path = str(tmp_path_factory.mktemp("days"))
    for day in range(6):
        rows = (bad if day == 4 else docs).withColumn("day", F.lit(day))
        if day == 3:
            rows = rows.unionByName(docs.limit(1).withColumns({"day": F.lit(1), "doc_id": F.lit("late one")}))
        rows.coalesce(1).write.mode("append").parquet(path)
    docs.unpersist()
    return path


def _streamed(spark, days, path, lag, name="routine", stop=None):
    """The routine over the day files, one a micro-batch; stop: (batch, place) where it dies once."""
    loop = routine.DailyStream(Ledger(spark, f"{path}/ledger"), warmup=3, remediator=lambda d: d.withColumn("text", routine.simple_reextract(F.col("text"))), lag=lag, name=name)
    if stop:
        plain = loop.ledger.advance

        def advance(name, n, *rest):
            if n == stop[0] and stop[1] == "before":
                raise Stopped("between ledger and state")
            plain(name, n, *rest)
            if n == stop[0]:
                raise Stopped("between state and checkpoint")

        loop.ledger.advance = advance
    source = spark.readStream.schema(spark.read.parquet(days).schema).option("maxFilesPerTrigger", 1).parquet(days)
    q = loop.start(source, f"{path}/checkpoint")
    try:
        assert q.awaitTermination(400)
    except Exception as e:
        assert stop and "Stopped" in str(e)
    return loop


def _shown(loop):
    said = sorted(str(r.asDict()) for r in loop.summaries().collect())
    held = loop.ledger.records("record").select("doc_id", "batch", "decision", "gate_quality", "fetch_time").collect()
    return said, sorted(map(str, held)), sorted(map(str, loop.ledger.current().select("doc_id", "batch", "decision").collect()))


@pytest.fixture(scope="module")
def whole(spark, day_files, tmp_path_factory):
    loop = _streamed(spark, day_files, str(tmp_path_factory.mktemp("whole")), 0)
    return loop, _shown(loop)


@pytest.mark.parametrize("place", ["before", "after"])
def test_a_stopped_routine_goes_on_as_if_it_had_not_been(spark, day_files, whole, tmp_path, place):
    whole, want = whole
    assert len(want[0]) == 6 and sum(r["late"] for r in whole.summaries().collect()) == 1 and "late one" in str(want[1])
    days = {r["day"]: r for r in whole.summaries().collect()}
    assert days[4]["alerts"] == ["quality_drift_down"] and days[4]["actions"] == ["hillclimb"] and days[3]["ok"]
    _streamed(spark, day_files, f"{tmp_path}/{place}", 0, stop=(3, place))
    again = Ledger(spark, f"{tmp_path}/{place}/ledger")
    assert (again.reached("routine")[0] < 3) == (place == "before")
    assert _shown(_streamed(spark, day_files, f"{tmp_path}/{place}", 0)) == want
    assert not [k for k in again.log.state().parts if k[1] == "routine"]  # nothing waits


def test_a_day_without_documents(spark, tmp_path):
    out = routine.Routine(ledger=Ledger(spark, str(tmp_path))).tick(routine.LocalHarness(), spark.createDataFrame([], routine.STAGED))
    assert (out["throughput"], out["quality"], out["ok"]) == (0.0, 1.0, True)


def test_a_lag_waits_for_late_documents(spark, day_files, tmp_path):
    loop = _streamed(spark, day_files, str(tmp_path), 2)
    days = {r["day"]: r for r in loop.summaries().collect()}
    assert set(days) == set(range(4)) and days[1]["throughput"] == 7.0 and not sum(r["late"] for r in days.values())
    assert loop.ledger.staged("routine", routine.STAGED).select("day").distinct().count() >= 2


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "modality": "odd"}\n\n{"id": "7", "source": "s"}\n')
    got = sorted(map(tuple, adapters.read_jsonl(spark, str(tmp_path / "a.jsonl")).select("doc_id", "text", "source", "modality").collect()))
    assert got == [("0", "x", "unknown", "text"), ("7", "", "s", "text")]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        adapters.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()


def test_rows_without_id_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text("".join('{"text": "row %d"%s}\n' % (k, ', "id": "own"' if k % 5 == 0 else "") for k in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = adapters.read_jsonl(spark, str(tmp_path / "long.jsonl"))
        assert got.rdd.getNumPartitions() > 1
        assert {r["text"]: r["doc_id"] for r in got.collect()} == {f"row {k}": "own" if k % 5 == 0 else str(k) for k in range(4000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
