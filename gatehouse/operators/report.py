"""Quality reports over decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.text import share
from gatehouse.operators.metrics import hits


def risk_grade(risk: Column) -> Column:
    return F.when(risk < 0.15, "none").when(risk < 0.40, "low").when(risk < 0.65, "medium").when(risk < 0.85, "high").otherwise("critical")


def summary(decided: DataFrame) -> DataFrame:
    """One row: counts and rates by label, the mean gate quality and the share that was escalated."""
    n = F.count(F.lit(1))
    of = {k: hits(F.col("label") == v) for v, k in enumerate(("n_filter", "n_review", "n_retain"))}
    rates = {k.replace("n_", "rate_"): F.round(share(v, F.greatest(F.lit(1), n)), 4) for k, v in of.items()}
    cols = {"n_docs": n, **of, **rates, "mean_gate_quality": F.round(F.coalesce(F.avg("gate_quality"), F.lit(1.0)), 4), "judge_calls": hits(F.col("escalated")), "judge_rate": F.round(share(hits(F.col("escalated")), F.greatest(F.lit(1), n)), 4)}
    return decided.agg(*[c.alias(k) for k, c in cols.items()])


def by(decided: DataFrame, key: str) -> DataFrame:
    """Documents, labels and mean quality by source, modality or stage."""
    return decided.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), hits(F.col("label") == 0).alias("n_filter"), hits(F.col("label") == 1).alias("n_review"), hits(F.col("label") == 2).alias("n_retain"), F.round(F.avg("gate_quality"), 6).alias("mean_gate_quality"))


def counts(decided: DataFrame) -> DataFrame:
    """All group counts of a report in one pass: kind, value, n."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in (("label", F.col("label_name")), ("stage", F.col("stage")), ("source", F.col("source")), ("modality", F.col("modality")), ("risk", risk_grade(F.col("risk"))))])
    return decided.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


def with_outliers(decided: DataFrame, profiles: DataFrame) -> DataFrame:
    """Decisions with their profile's outlier flags, where there is one."""
    return decided.join(profiles.select("doc_id", "outlier_flags", "outlier_score", "is_outlier"), "doc_id", "left")


def markdown(decided: DataFrame, title: str = "Curation report") -> str:
    """The report as text: decisions, responsible stages, sources, risk. What the driver reads is group counts; sources are the 1000 largest."""
    s = summary(decided).first().asDict()
    rows = counts(decided).where("kind <> 'source'").unionByName(counts(decided.select("source", *[F.lit("").alias(c) for c in ("label_name", "stage", "modality")], F.lit(0.0).alias("risk"))).where("kind = 'source'").orderBy(F.desc("n"), "value").limit(1000))
    groups: dict[str, list] = {}
    for r in rows.orderBy(F.desc("n"), "value").toLocalIterator():
        groups.setdefault(r["kind"], []).append((r["value"], r["n"]))
    out = [f"# {title}", "", f"{s['n_docs']} documents; mean gate quality {s['mean_gate_quality']:.4f}; {s['judge_calls']} judge calls."]
    for kind, head in (("label", "Decisions"), ("stage", "Responsible stages"), ("source", "Sources"), ("modality", "Modalities"), ("risk", "Risk")):
        out += ["", f"## {head}", "", f"| {kind} | documents |", "|-|-|", *[f"| {v} | {n} |" for v, n in groups.get(kind, [])]]
    return "\n".join(out) + "\n"
