"""Acceptance scenarios: gates against the mutation oracle, search regimes, drift, outliers and baselines, on generated corpora.

Draws are hashes, so figures are comparable with published ones within tolerances, not digit by digit. Reports of search regimes use
documents that neither the search nor its accept rule has seen.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gatehouse.functions.text import features
from gatehouse.operators import baselines, climb, gates, metrics, mutate, outliers, verify
from gatehouse.operators.cascade import with_score
from gatehouse.sources.adapters import clean_corpus, documents, draw, table
from gatehouse.streaming import routine, spc


def _docs(spark: SparkSession, kind: str, n: int, seed: int):
    return clean_corpus(spark, n, seed, (kind,))


def _fitted(spark: SparkSession, kind: str, docs):
    if kind != "json":
        return gates.GATES[kind]
    schema = {r["key"]: r["kind"] for r in gates.infer_schema(docs).collect()}  # keys of one record
    return gates.Gate("json", gates.JSON.weights, gates.JSON.signals, reads="raw", schema=schema)


def gate_oracle(spark: SparkSession, n: int = 80, seeds=range(5)) -> dict:
    """Held-out floor and train upper F1 of each gate, and its false positives on clean documents."""
    out = {}
    for kind in ("html", "ocr", "json"):
        docs = _docs(spark, kind, n, 7)
        gate = _fitted(spark, kind, docs)
        rows = {r["slice"]: r for r in verify.floor_and_upper(verify.signals(gate, docs, kind, seeds, ("heldout", "train")), gate).collect()}
        out[kind] = {"floor": rows["heldout"]["f1"], "upper": rows["train"]["f1"], "gap": rows["train"]["f1"] - rows["heldout"]["f1"], "guard_fpr": rows["heldout"]["fpr"]}
    return out


def search_regimes(spark: SparkSession, n: int = 60, iterations: int = 30, population: int = 10, step: float = 0.12) -> dict:
    """Naive recall, naive F1 and the verified regime from halved HTML weights; the last entry of each is measured on a third set."""
    start = gates.HTML.with_params({k: w / 2 for k, w in gates.HTML.weights.items()})
    config = climb.ClimbConfig(iterations=iterations, population=population, step=step)
    apart = verify.signals(start, _docs(spark, "html", n, 9), "html", range(30, 35)).persist()
    out = {}
    for regime in ("naive_recall", "naive_f1", "verified"):
        done = climb.hillclimb(start, _docs(spark, "html", n, 7), "html", regime, config, _docs(spark, "html", n, 8))
        out[regime] = {"trajectory": done.trajectory, "apart": verify.objective(verify.score(apart, [done.gate])).first().asDict()}
    return out


def drift(spark: SparkSession, streams: int = 8, days: int = 30, shift: int = 15, warmup: int = 10, per_day: int = 40) -> list[dict]:
    """Streams whose documents are half corrupted from the shift day on: detection latency, false alarms, recovery."""
    out = []
    for s in range(streams):
        loop, harness = routine.Routine(warmup, lambda d: d.withColumn("text", routine.simple_reextract(F.col("text")))), routine.LocalHarness()
        for day in range(days):
            docs = _docs(spark, "html", per_day, 1000 * s + day)
            if day >= shift:
                bad = draw(s, F.col("doc_id"), "bad") % 2 == 0
                docs = docs.where(~bad).unionByName(mutate.corrupt(docs.where(bad), "html", day).drop("operator", "slice", "seed"))
            loop.tick(harness, docs)
        alarms = [x["day"] for x in harness.summaries if "quality_drift_down" in x["alerts"]]
        after = [d for d in alarms if d >= shift]
        back = [x["day"] for x in harness.summaries if "recovered" in x["actions"]]
        out.append({"stream": s, "latency": after[0] - shift if after else None, "false_alarms": sum(d < shift for d in alarms), "recovery": back[0] - shift if back else None})
    return out


def outlier_methods(spark: SparkSession, n: int = 400, z: float = 3.5) -> dict:
    """Robust z against mean and deviation, on a corpus with every eighth document made anomalous in one of four ways."""
    kind = F.pmod(F.col("_n"), F.lit(32)) / 8
    docs = clean_corpus(spark, n, 5).withColumn("source", F.lit("web")).withColumn("_n", F.substring("doc_id", 7, 5).cast("int"))
    odd = F.pmod(F.col("_n"), F.lit(8)) == 0
    text = F.when(kind == 0, F.lit("x")).when(kind == 1, F.repeat(F.lit("word "), 300)).when(kind == 2, F.translate("text", "aeiou", "#%&*@")).otherwise(F.repeat(F.concat("text", F.lit(" ")), 12))
    rows = features(docs.withColumn("text", F.when(odd, text).otherwise(F.col("text")))).persist()
    gold = rows.select("doc_id", odd.cast("int").alias("gold"))
    out = {}
    for name, found in (("robust", outliers.profile(rows, z)), ("k_sigma", outliers.k_sigma(rows, z))):
        out[name] = found.join(gold, "doc_id").agg(*[v.alias(k) for k, v in metrics.binary_prf(F.col("is_outlier").cast("int"), F.col("gold")).items()]).first().asDict()
    rows.unpersist()
    return out


def drift_recovery(spark: SparkSession, n: int = 80, iterations: int = 25, population: int = 12, step: float = 0.15) -> dict:
    """A gate blind to markup meets leaked tags: before and after a verified climb."""
    blind = gates.HTML.with_params({"markup_leak": 0.0})
    test = verify.signals(blind, _docs(spark, "html", n, 8), "html", range(20, 25), ("heldout",), ("tag_inject",)).persist()
    done = climb.hillclimb(blind, _docs(spark, "html", n, 7), "html", "verified", climb.ClimbConfig(iterations, population, step), _docs(spark, "html", n, 8), ops=("tag_inject",))
    read = lambda g: verify.objective(verify.score(test, [g])).first().asDict()
    return {"blind": read(blind), "verified": read(done.gate), "markup_weight": done.gate.weights["markup_leak"]}


def against_baselines(spark: SparkSession, n: int = 80, seeds=range(5)) -> dict:
    """Mean held-out F1 of each gate and of the simple detectors of its modality."""
    out = {}
    for kind in ("html", "ocr", "json"):
        docs = _docs(spark, kind, n, 7)
        detectors = {"gate": _fitted(spark, kind, docs), **baselines.fitted_baselines(kind, docs)}
        out[kind] = {name: verify.objective(verify.score(verify.signals(g, docs, kind, seeds), [g])).first()["f1"] for name, g in detectors.items()}
    return out


def cascade(spark: SparkSession, sf_dir: str) -> dict:
    """The budget curve with the labels of a folder as judge, from no judge calls to all, and the share of the gain that half of them recover."""
    gold = F.when(F.col("quality") == 1, 2).otherwise(0)
    rows = with_score(documents(spark, sf_dir)).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("governance_score").alias("score"), gold.alias("judge_label"), gold.alias("gold"))
    curve = {r["fraction"]: r.asDict() for r in metrics.budget_curve(rows).collect()}  # a row for each fraction
    low, half, high = (curve[f]["macro_f1"] for f in (0.0, 0.5, 1.0))
    return {"curve": curve, "recovered": (half - low) / (high - low) if high != low else 0.0}


def charts(spark: SparkSession, series, warmup: int = 10):
    """EWMA and CUSUM over any (stream, day, value)."""
    return spc.monitor(series, warmup)


ALL = {"gate_oracle": gate_oracle, "search_regimes": search_regimes, "drift": drift, "outlier_methods": outlier_methods, "drift_recovery": drift_recovery, "against_baselines": against_baselines}
