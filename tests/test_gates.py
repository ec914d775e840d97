import json

import pytest
from pyspark.sql import functions as F

from gatehouse.functions import counts
from gatehouse.operators import gates

CLEAN = "Background\n\nThe committee described the structure of the signal in detail. It is a plausible explanation for the trend, and the result was consistent with that of the study."


def evaluate(spark, gate, rows):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(rows)], "doc_id int, text string, raw string")
    return sorted(gate.evaluate(df).collect(), key=lambda r: r["doc_id"])


def test_html_gate(spark):
    got = evaluate(spark, gates.HTML, [CLEAN, "<div class='x'>Menu</div>\nSign In\nLog In\nRead More\n" + CLEAN, "", None])
    assert got[0]["gate_passed"] and not got[1]["gate_passed"] and "markup_leak" in got[1]["gate_flags"]
    assert got[2]["s_stopword_deficit"] == 1.0 and got[3]["gate_quality"] == got[2]["gate_quality"]


def test_ocr_gate(spark):
    got = evaluate(spark, gates.OCR, [CLEAN, "Thc c0mmittcc dcscr1bcd ¬ thc | strxctxrc 0f th3 s1gnxl ^ ~ wOrld aaaa bcdfg l 1 0", ""])
    assert got[0]["gate_passed"] and not got[1]["gate_passed"] and got[2]["gate_quality"] == 1.0


def test_garbage_tokens():
    cases = {"bcd": True, "ab": False, "word": False, "wOrd": True, "WORD": False, "aaaa": True, "bbba": False, "strng": True, "3rd": False, "eaiou": True}
    assert {k: counts.garbage(k) for k in cases} == cases


JSON_CASES = ['{"a": 1}', '{"a": 1', '{"a": 1} x', '{"a":1}{"b":2}', '{"a": [1, {"b": "}"}]}', '"s"', "[1, 2]", "", "{'a': 1}", '{"a": "\t"}', '{"a": 1,}', '{"a": "q\\"{"}', "nul", "12", '{"a":']


def test_json_strictness_and_balance(spark):
    df = spark.createDataFrame([(c,) for c in JSON_CASES], "raw string").withColumn("text", F.lit(""))
    got = {r["raw"]: r for r in gates.json_columns(df).select("raw", gates.parses().alias("p"), gates.balanced().alias("b")).collect()}

    def parses(x):
        try:
            json.loads(x)
        except ValueError:
            return False
        return True

    assert {k: v["p"] for k, v in got.items()} == {c: parses(c) for c in JSON_CASES}
    assert not got['{"a": 1']["b"] and got['{"a": [1, {"b": "}"}]}']["b"] and got['{"a": "q\\"{"}']["b"] and not got['{"a":']["b"]


def test_json_gate_with_schema(spark):
    gate = gates.Gate("json", gates.JSON.weights, gates.JSON.signals, reads="raw", schema={"a": "int", "b": "float", "c": "string"})
    rows = ['{"a": 1, "b": 1, "c": "x"}', '{"a": "1", "b": 1.0, "c": "x"}', '{"a": true, "b": 2.5, "c": null}', '{"b": 1e2, "c": []}', '{"a": 1, "b": 2, "c": ""}', "[1]", '{"a"']
    got = evaluate(spark, gate, rows)
    assert [r["gate_passed"] for r in got] == [True, False, False, False, False, True, False]  # an empty value weighs 0.5 * 1.6
    assert [round(r["s_type_mismatch"], 3) for r in got] == [0, 0.6, 0.6, 0.6, 0, 0, 0]
    assert [round(r["s_empty_value"], 3) for r in got] == [0, 0, 0.5, 0.5, 0.5, 0, 0]
    assert got[3]["s_schema_missing"] == 0.6 and got[6]["s_truncated"] == 1.0 and got[6]["gate_quality"] == 0.0


def test_schema_is_inferred_from_required_keys_and_modal_types(spark):
    rows = [(i, json.dumps({"k": i, "s": "x", "n": None, **({"rare": 1} if i < 2 else {})})) for i in range(9)] + [(9, '{"k": "text", "s": "y", "n": null}'), (10, "broken")]
    got = {r["key"]: r["kind"] for r in gates.infer_schema(spark.createDataFrame(rows, "doc_id int, raw string")).collect()}
    assert got == {"k": "int", "s": "string", "n": "string"}


def test_parameters_stay_within_bounds():
    g = gates.HTML.with_params({"markup_leak": -3, "threshold": 2, "unknown": 1})
    assert g.weights["markup_leak"] == 0.0 and g.threshold == 0.95 and list(g.params()) == [*gates.HTML.weights, "threshold"]
    assert gates.HTML.with_params(gates.HTML.params()) == gates.HTML


def test_quality_at_the_threshold_passes(spark):
    gate = gates.Gate("t", {"s": 1.0}, lambda _: {"s": F.lit(0.5)})
    got = evaluate(spark, gate, ["x"])[0]
    assert got["gate_passed"] and got["gate_flags"] == ["s"] and got["gate_quality"] == pytest.approx(0.5)


def test_records_are_judged_once(spark):
    """Keys were once judged by interpreted lambdas, three times a record, and records parsed twice to infer their schema."""
    raws = ['{"a": 1, "b": ""}', '{"a": "x", "b": null}', '{"b": []}', "[]", "[}", "{]", "][", "{}", "{} {}", "[{}]", '{"a": {"b": [1]}}', '{"a": "{"}', '{"a": "}', "", "7", None]
    df = spark.createDataFrame([(i, r, "") for i, r in enumerate(raws)], "doc_id int, raw string, text string")
    got = {r["doc_id"]: r for r in gates.json_columns(df).select("doc_id", "_fold.*", "_rest").collect()}
    for i, r in got.items():
        depth = low = n = closed = 0
        for c in r["_rest"]:
            if c in "[]{}":
                depth, n = depth + (1 if c in "[{" else -1), n + 1
                low, closed = min(low, depth), closed or (n if depth == 0 else 0)
        assert (r["depth"], r["low"], r["n"], r["closed"]) == (depth, low, n, closed), raws[i]
    gate = gates.Gate("json", gates.JSON.weights, gates.JSON.signals, reads="raw", schema={"a": "int", "b": "string"})
    made = gate.evaluate(df)
    seen = {r["doc_id"]: (r["s_schema_missing"], r["s_type_mismatch"], r["s_empty_value"]) for r in made.collect()}
    assert [seen[i] for i in (0, 1, 2, 3, 7, 15)] == [(0.0, 0.0, 0.5), (0.0, 0.6, 0.5), (0.6, 0.6, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("jsonObjectKeys") == 1 and "transform(" not in plan
