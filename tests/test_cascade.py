import pytest
from pyspark.sql import functions as F

from gatehouse.operators import metrics, report
from gatehouse.operators.cascade import Config, curate, provenance, with_score
from gatehouse.sources.ledger import Ledger

GOOD = "In 1998 the committee of the Royal Society described the structure of the signal that Darwin and Huxley had found in 1859. It was measured by the team of Newton in 12 cities, and the result of the study was confirmed in 2004 by a group from London. " * 1
SPAM = "Buy now and click here for free money! Buy now and click here! " * 5


def docs(spark, rows):
    return spark.createDataFrame([(str(i), t, "web", m, r) for i, (t, m, r) in enumerate(rows)], "doc_id string, text string, source string, modality string, raw string")


def test_spam_is_filtered_and_knowledge_is_not(spark):
    got = {r["doc_id"]: r for r in curate(docs(spark, [(GOOD, "text", None), (SPAM, "text", None), ("", "text", None), (None, "text", None)])).collect()}
    assert got["0"]["label"] > 0 and got["1"]["label_name"] == "filter" and got["1"]["stage"] == "score" and got["2"]["score"] == 0.0 and got["3"]["label"] == 0


def test_gate_failures_are_filtered_with_their_reason(spark):
    rows = [("<div>" * 30 + "menu", "html", None), ("fine", "json", '{"a": 1'), (GOOD, "unknown", None), ("", "json", '{"a": 1}')]
    got = {r["doc_id"]: r for r in curate(docs(spark, rows)).collect()}
    assert got["0"]["stage"] == "gate" and got["0"]["reasons"][0].startswith("extraction_defect:markup_leak") and got["0"]["score"] == got["0"]["gate_quality"]
    assert got["1"]["stage"] == "gate" and got["2"]["extractor"] == "surface@v1"
    assert got["3"]["stage"] == "score" and got["3"]["label"] == 0  # a passing record with an empty text


def test_modes_and_the_judge_is_asked_only_about_escalated_rows(spark):
    rows = docs(spark, [(GOOD, "text", None), (SPAM, "text", None), ("The cat is on the mat and the dog is in the house.", "text", None)])
    assert curate(rows, "judge").where("escalated").count() == 3
    asked = []

    def judge(df):
        asked.append(df.count())
        return df.withColumns({"label": F.lit(2), "score": F.lit(0.9), "stage": F.lit("judge"), "reasons": F.array(F.lit("ok")), "risk": F.lit(0.1)})

    got = curate(rows, "cascade", judge=judge)
    assert asked == [got.where("escalated").count()] and got.where("stage = 'judge'").count() == asked[0] and got.count() == 3


def test_thresholds_are_inclusive(spark):
    rows = with_score(docs(spark, [(GOOD, "text", None)]))
    s = rows.first()["governance_score"]
    assert curate(docs(spark, [(GOOD, "text", None)]), config=Config(retain_above=s)).first()["label"] == 2
    assert curate(docs(spark, [(GOOD, "text", None)]), config=Config(retain_above=0.99, filter_below=s)).first()["label"] == 0


def test_config_hash_is_stable():
    assert Config().config_hash() == Config(gates={"ocr": 0.5, "json": 0.5, "html": 0.5}).config_hash() and len(Config().config_hash()) == 12


def test_report_of_nothing_and_of_some(spark):
    rows = docs(spark, [(GOOD, "text", None)] * 3 + [(SPAM, "text", None)])
    s = report.summary(curate(rows)).first()
    assert s["n_docs"] == 4 and s["n_filter"] == 1 and s["mean_gate_quality"] == 1.0
    empty = report.summary(curate(rows.where("false"))).first()
    assert empty["n_docs"] == 0 and empty["mean_gate_quality"] == 1.0 and empty["rate_filter"] == 0.0
    text = report.markdown(curate(rows))
    assert "4 documents" in text and "| web | 4 |" in text
    profiles = spark.createDataFrame([("0", ["x"], 4.0, True)], "doc_id string, outlier_flags array<string>, outlier_score double, is_outlier boolean")
    assert report.with_outliers(curate(rows), profiles).where("is_outlier").count() == 1


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (2, 2), (2, 0), (1, 2)], "p int, g int")
    r = df.agg(metrics.macro_f1(F.col("p"), F.col("g")).alias("m"), metrics.agreement(F.col("p"), F.col("g")).alias("a")).first()
    assert r["a"] == pytest.approx(0.6) and r["m"] == pytest.approx((0.8 + 0 + 0.5) / 3)
    b = df.where("p < 2 and g < 2").agg(*[v.alias(k) for k, v in metrics.binary_prf(F.col("p"), F.col("g")).items()]).first()
    assert (b["precision"], b["recall"], b["f1"]) == (0.0, 0.0, 0.0)


def test_ledger_appends_traces_and_supersedes(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = provenance(curate(docs(spark, [(GOOD, "text", None), (SPAM, "text", None)])), "t0")
    ledger.append(first, 0)
    ledger.append(first, 0)  # the same batch again
    ledger.append_summary({"day": 0}, 0)
    ledger.supersede(first.where("doc_id = '1'").withColumn("decision", F.lit("retain")), 1)
    assert ledger.records("record").count() == 2 and ledger.records().count() == 4
    assert [r["decision"] for r in ledger.trace("1").collect()] == ["filter", "retain"]
    assert {r["doc_id"]: r["decision"] for r in ledger.current().collect()}["1"] == "retain"


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_a_budget_is_spent_exactly_on_the_middle(spark, share):
    texts = [(f"{'The cat is on the mat. ' * (1 + k % 4)}", "text", None) for k in range(25)] + [(GOOD, "text", None), (SPAM, "text", None), ("<div>" * 30 + "menu", "html", None)]
    rows = docs(spark, texts)
    asked = []

    def judge(df):
        asked.append(df.count())
        return df.withColumns({"label": F.lit(2), "score": F.lit(0.9), "stage": F.lit("judge"), "reasons": F.array(F.lit("asked")), "risk": F.lit(0.0)})

    got = {r["doc_id"]: r for r in curate(rows, "budget", judge=judge, share=share).collect()}
    n = len(texts) - 1
    k = round(share * n)
    low = (n - k) // 2
    order = sorted((round(r["_score"], 9), r["doc_id"]) for r in with_score(rows, "_score").where("modality = 'text'").collect())
    want = {d: 0 if i < low else 2 if i >= low + k else 1 for i, (_, d) in enumerate(order)}
    assert asked == [k] and len(got) == n + 1 and got["27"]["stage"] == "gate"
    assert {d: (1 if r["stage"] == "judge" else r["label"]) for d, r in got.items() if d != "27"} == want
