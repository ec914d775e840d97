import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gatehouse.operators.cascade import curate
from gatehouse.operators.judging import KeptJudge

MIDDLE = "The cat is on the mat and the dog is in the house."


def stub(folder, fail_first=0, broken=()):
    """Answers by the length of a text; every call for a text is noted in a file, the first calls of some fail, and others always do."""

    def ask(texts):
        out = []
        for t in texts:
            mark = Path(folder) / hashlib.md5(t.encode()).hexdigest()
            with open(mark, "a") as f:
                f.write("x")
            tries = mark.stat().st_size
            bad = t in broken or (fail_first and len(t) % 3 == 0 and tries <= fail_first)
            out.append(None if bad else (len(t) % 3, 0.7, f"length {len(t)}"))
        return out

    return ask


def calls(folder):
    return {p.name: p.stat().st_size for p in Path(folder).iterdir()}


@pytest.fixture()
def rows(spark):
    texts = [MIDDLE + "!" * (k % 20) for k in range(60)] + [None, ""]
    return spark.createDataFrame([(f"d{k}", t, "web", "text", None) for k, t in enumerate(texts)], "doc_id string, text string, source string, modality string, raw string").repartition(4)


def test_every_text_is_asked_once_and_failures_again(spark, rows, tmp_path):
    (tmp_path / "calls").mkdir()
    judge = KeptJudge(spark, str(tmp_path / "kept"), stub(tmp_path / "calls", 2), attempts=3, share=7, batch=3)
    got = {r["doc_id"]: r for r in curate(rows, "judge", judge=judge).collect()}
    assert len(got) == 62 and {r["stage"] for r in got.values()} == {"judge"}
    assert all(got[f"d{k}"]["label"] == (len(MIDDLE) + k % 20) % 3 and got[f"d{k}"]["reasons"] == [f"length {len(MIDDLE) + k % 20}"] for k in range(60)) and got["d60"]["label"] == got["d61"]["label"] == 0
    seen = calls(tmp_path / "calls")
    assert len(seen) == 21 and set(seen.values()) == {1, 3}  # twenty texts and the empty one; those that failed twice were asked three times
    again = KeptJudge(spark, str(tmp_path / "kept"), stub(tmp_path / "calls"))
    assert {r["doc_id"]: r["label"] for r in curate(rows, "judge", judge=again).collect()} == {d: r["label"] for d, r in got.items()}
    assert calls(tmp_path / "calls") == seen


def test_a_run_goes_on_and_what_has_no_verdict_stays_open(spark, rows, tmp_path):
    (tmp_path / "calls").mkdir()
    ask, n = stub(tmp_path / "calls", broken=(MIDDLE,)), 21
    first = KeptJudge(spark, str(tmp_path / "kept"), ask, attempts=1, limit=8)
    stages = [r["stage"] for r in curate(rows, "judge", judge=first).collect()]
    assert sum(calls(tmp_path / "calls").values()) == 8 and "judge-open" in stages and "judge" in stages
    rest = KeptJudge(spark, str(tmp_path / "kept"), ask, attempts=2)
    got = {r["doc_id"]: r for r in curate(rows, "judge", judge=rest).collect()}
    open_ones = {d for d, r in got.items() if r["stage"] == "judge-open"}
    assert open_ones == {"d0", "d20", "d40"} and all(got[d]["label"] == 1 and got[d]["score"] == 0.5 for d in open_ones)
    seen = calls(tmp_path / "calls")
    assert len(seen) == n and sorted(set(seen.values())) in ([1, 2], [1, 3])


def test_a_call_that_raises_is_a_failure(spark, tmp_path):
    def ask(texts):
        raise OSError("no service")

    one = spark.createDataFrame([("a", MIDDLE, "web", "text", None)], "doc_id string, text string, source string, modality string, raw string")
    got = curate(one, "judge", judge=KeptJudge(spark, str(tmp_path / "kept"), ask, attempts=1)).first()
    assert got["stage"] == "judge-open" and got["label_name"] == "review"
    assert curate(one.where(F.lit(False)), "judge", judge=KeptJudge(spark, str(tmp_path / "none"), ask)).count() == 0
