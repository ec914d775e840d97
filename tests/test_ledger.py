import threading

import pytest
from pyspark.sql import functions as F

from gatehouse.functions.text import features
from gatehouse.operators import outliers
from gatehouse.operators.window import Window
from gatehouse.sources import commits
from gatehouse.sources.ledger import Ledger


def rows(spark, decision, ids):
    return spark.createDataFrame([(str(i), decision) for i in ids], "doc_id string, decision string")


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    path, n = str(tmp_path / "ledger"), 6
    ledgers = [Ledger(spark, path, w) for w in ("a", "b", "c")]
    parts = {x.writer: [x._written(rows(spark, x.writer, [k]), k, "record") for k in range(n)] for x in ledgers}

    def write(x):
        for p in parts[x.writer]:
            x.log.commit(lambda state, p=p: [p])

    threads = [threading.Thread(target=write, args=(x,)) for x in ledgers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = Ledger(spark, path).records()
    assert got.count() == 3 * n and ledgers[0].log.state().version == 3 * n - 1
    assert {(r["decision"], r["batch"]) for r in got.collect()} == {(w, k) for w in "abc" for k in range(n)}


def test_current_as_of_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT", 3)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    said = lambda upto=None: {r["doc_id"]: r["decision"] for r in ledger.current(upto).collect()}
    assert said() == {}
    for batch, (decision, ids) in enumerate((("one", range(4)), ("two", (1, 2)), ("three", (2, 9)))):
        (ledger.supersede if batch else ledger.append)(rows(spark, decision, ids), batch)
    now = {"0": "one", "1": "two", "2": "three", "3": "one", "9": "three"}
    assert said() == now and said(0) == dict.fromkeys("0123", "one") and said(1)["2"] == "two"
    ledger.compact()
    folder = ledger.log.state().compacted[0]
    assert all(folder in f for f in ledger.current().inputFiles()) and said() == now
    assert said(1)["2"] == "two" and ledger.trace("2").count() == 3  # history stays
    ledger.supersede(rows(spark, "four", [0]), 3)
    assert said() == {**now, "0": "four"} and any(folder in f for f in ledger.current().inputFiles())
    ledger.append(rows(spark, "again", range(2)), 0)  # a batch that the compaction holds is replaced
    assert ledger.log.state().compacted is None and said() == {"0": "four", "1": "two", "2": "three", "9": "three"}
    ledger.compact()
    before = said()
    assert ledger.log.vacuum() == 2 and said() == before  # the replaced part and the first compaction
    assert commits.State.loaded(ledger.log.state().dumped()) == ledger.log.state()


def test_a_commit_is_taken_once(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    assert log._take("x.commit.json", "[]") and not log._take("x.commit.json", "[1]") and log._read("x.commit.json") == "[]"


def test_advance_is_once_for_a_batch(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.reached("s") is None
    assert ledger.advance("s", 0, {"x": 1}, [{"day": 0}]) and not ledger.advance("s", 0, {"x": 2}, [{"day": 0}])
    assert ledger.reached("s") == (0, {"x": 1}) and ledger.records("summary").count() == 1


@pytest.fixture(scope="module")
def texts(spark):
    made = [(i, f"{'Words of a text. ' * (1 + i * 7 % 23)}{'x' * (i % 5)}", "big" if i % 3 else None, i % 4) for i in range(90)] + [(200, "!!!! " * 300, "big", 3)]
    return features(spark.createDataFrame(made, "doc_id long, text string, source string, day int")).persist()


def test_days_added_one_by_one_equal_a_fit_of_all(spark, tmp_path, texts):
    window = Window(spark, str(tmp_path / "window"))
    key = lambda df: sorted(str((r["pooled"], r["source"], r["feature"], r["n"], round(r["med"], 12), round(r["mad"], 12))) for r in df.collect())
    for day in range(4):
        window.add(texts.where(F.col("day") == day), day)
        if day == 2:
            window.add(texts.where(F.col("day") == day), day)  # again
        assert window.fit() == day + 1
        assert key(window.stats()) == key(outliers.fit(texts.where(F.col("day") <= day)))
    assert window.versions() == [1, 2, 3, 4] and key(window.stats(2)) == key(outliers.fit(texts.where("day <= 1")))
    assert window.fit(upto=0) == 5 and key(window.stats(5)) == key(window.stats(1))


def test_a_stream_is_scored_against_a_version(spark, tmp_path, texts):
    window = Window(spark, str(tmp_path / "window"), ("char_length", "token_length"))
    window.add(texts, 0)
    version = window.fit()
    texts.select("doc_id", "source", "text").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, source string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scored = window.score(features(stream, window.names), version)
    q = scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    window.add(texts.limit(1), 1)
    window.fit()  # a later version leaves the stream alone
    assert q.awaitTermination(240)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("scored")) == key(window.score(texts, version)) and spark.table("scored").where("is_outlier").count()
