"""The governance score and the decision cascade: gate, score, judge, provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut
from gatehouse.functions import lexicon as X
from gatehouse.functions.order import banded
from gatehouse.functions.text import clamp, count, counted, expressions
from gatehouse.operators.gates import GATES, Gate

FILTER, REVIEW, RETAIN = 0, 1, 2
NAMES = {FILTER: "filter", REVIEW: "review", RETAIN: "retain"}
SCORE_FEATURES = ("token_length", "type_token_ratio", "stopword_fraction", "bigram_repetition", "dup_line_fraction", "top_ngram_fraction")
MODALITIES = ("html", "ocr", "json", "text")


@dataclass(frozen=True)
class Config:
    """Thresholds of the gates by modality, and where the score retains or filters (both inclusive)."""

    gates: Mapping[str, float] = field(default_factory=lambda: {"html": 0.5, "json": 0.5, "ocr": 0.5})
    retain_above: float = 0.62
    filter_below: float = 0.30

    def config_hash(self) -> str:
        text = "|".join(f"{m}:{self.gates[m]:.4f}" for m in sorted(self.gates)) + f"|cas:{self.retain_above:.3f},{self.filter_below:.3f}"
        return hashlib.sha1(text.encode()).hexdigest()[:12]


def spam_hits(text: Column) -> Column:
    low = F.lower(text)
    return sum((F.contains(low, F.lit(p)).cast("int") for p in X.SPAM), F.lit(0))


def governance_score(f: Mapping[str, Column], text: Column) -> Column:
    """Surface value of a text from 0 to 1: function words, diversity, length and facts, less repetition and spam."""
    tokens = f["token_length"]
    facts = count(text, X.NUMBER) + count(text, X.PROPER_NOUN)
    base = (
        F.lit(0.28) * F.least(F.lit(1.0), f["stopword_fraction"] / 0.30) + F.lit(0.16) * f["type_token_ratio"] + F.lit(0.20) * F.least(F.lit(1.0), tokens / 120.0)
        + F.lit(0.26) * F.least(F.lit(1.0), facts / (F.greatest(F.lit(1.0), tokens) / 8.0)) - F.lit(0.5) * (f["bigram_repetition"] + f["dup_line_fraction"] + f["top_ngram_fraction"])
    )
    return clamp(base - F.lit(0.6) * F.least(F.lit(1), spam_hits(text)))


def with_score(df: DataFrame, name: str = "governance_score", where: Column | None = None) -> DataFrame:
    """df with the governance score of its text; where: rows that need one, the texts of others aren't read."""
    made = expressions("_scored")
    parts = counted(df.withColumn("_scored", F.col("text") if where is None else F.when(where, F.col("text"))), SCORE_FEATURES, "_scored")
    parts = parts.withColumns({f"_f_{k}": made[k] for k in SCORE_FEATURES})
    score = governance_score({k: F.col(f"_f_{k}") for k in SCORE_FEATURES}, F.col("_scored"))
    return parts.withColumn(name, score).drop("_scored", "_words", "_pairs", "_lines", *[f"_f_{k}" for k in SCORE_FEATURES])


GATED = {"gate_quality": "double", "gate_passed": "boolean", "gate_flags": "array<string>", "extractor": "string"}


def gated(docs: DataFrame, gates: Mapping[str, Gate] | None = None, config: Config | None = None) -> DataFrame:
    """docs with gate_quality, gate_passed, gate_flags and extractor by modality, in one reading. A gate gets the texts of its modality alone;
    plain text has no gate."""
    config = config or Config()
    gates = dict(GATES if gates is None else gates)
    raw = F.col("raw") if "raw" in docs.columns else F.lit(None).cast("string")
    so_far = {"gate_quality": F.lit(1.0), "gate_passed": F.lit(True), "gate_flags": F.array().cast("array<string>"), "extractor": F.lit("surface@v1")}
    out = docs.drop(*GATED).withColumns({"_text": F.col("text"), "_record": raw, **{f"_{k}": v for k, v in so_far.items()}})
    kept = [c for c in out.columns if c not in ("text", "raw")]
    for name, gate in gates.items():
        if name in config.gates:
            gate = gate.with_params({"threshold": config.gates[name]})
        mine = F.coalesce(F.col("modality") == name, F.lit(False))
        seen = gate.evaluate(out.withColumns({"text": F.when(mine, F.col("_text")), "raw": F.when(mine, F.col("_record"))})).withColumn("extractor", F.lit(f"{name}-gate@v1"))
        out = seen.withColumns({f"_{k}": F.when(mine, F.col(k)).otherwise(F.col(f"_{k}")) for k in GATED}).select(*kept)
    own = {"text": F.col("_text"), "raw": F.col("_record")}
    return out.select(*[own.get(c, F.col(c)).alias(c) for c in docs.columns if c not in GATED], *[F.col(f"_{k}").cast(t).alias(k) for k, t in GATED.items()])


def curate(docs: DataFrame, mode: str = "heuristic", gates: Mapping[str, Gate] | None = None, config: Config | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, share: float = 0.2) -> DataFrame:
    """docs (doc_id, text, source, modality, raw) with a decision: label, label_name, score, stage, reasons, gate_quality, risk, escalated.

    mode "heuristic" reviews the middle of the score, "cascade" sends it to the judge, "judge" sends all that pass the gate. "budget" sends just
    round(share * n) of the n that pass, those in the middle of the order of (score to nine places, doc_id); what lies below is filtered, above
    retained. judge adds label,
    score, stage, reasons and risk to the rows it is given, which are the escalated ones only; without one they are marked for review.
    """
    config = config or Config()
    rows = with_score(gated(docs, gates, config), "_score", F.col("gate_passed"))
    s = F.col("_score")
    high, low = s >= F.lit(config.retain_above), s <= F.lit(config.filter_below)
    if mode == "budget":
        rows = cut(rows.withColumn("_rank", F.round("_score", 9)))
        n = rows.where("gate_passed").count()
        k = round(share * n)  # half to even
        passed = banded(rows.where("gate_passed"), "_rank", (n - k) // 2, (n - k) // 2 + k, "doc_id", name="_band")
        rows = passed.unionByName(rows.where("NOT gate_passed").withColumn("_band", F.lit(0))).drop("_rank")
        high, low = F.col("_band") > 0, F.col("_band") < 0
    ask = F.lit(True) if mode == "judge" else (F.lit(False) if mode == "heuristic" else ~high & ~low)
    rows = rows.withColumn("escalated", F.col("gate_passed") & ask)
    fail = ~F.col("gate_passed")
    label = F.when(fail, FILTER).when(F.col("escalated"), REVIEW).when(high, RETAIN).when(low, FILTER).otherwise(REVIEW)
    stage = F.when(fail, "gate").when(F.col("escalated"), "judge-stub").otherwise("score")
    reasons = F.when(fail, F.array(F.concat(F.lit("extraction_defect:"), F.array_join("gate_flags", ",")))).when(F.col("escalated"), F.array(F.lit("no judge; escalated to human review"))).otherwise(F.array().cast("array<string>"))
    decided = {"label": label, "score": F.when(fail, F.col("gate_quality")).when(F.col("escalated"), F.lit(0.5)).otherwise(s), "stage": stage, "reasons": reasons, "risk": F.lit(0.0)}
    if judge is None:
        out = rows.withColumns(decided)
    else:  # a judge inside a condition would be asked about every row
        asked = judge(rows.where("escalated"))
        out = rows.where(~F.col("escalated")).withColumns(decided)
        out = out.unionByName(asked.select(*out.columns))
    name = F.element_at(F.array(*[F.lit(NAMES[k]) for k in sorted(NAMES)]), F.col("label") + 1)
    return out.drop("_score", "_band").withColumn("label_name", name)


def provenance(decided: DataFrame, fetch_time: str, config: Config | None = None) -> DataFrame:
    """One record for each decision."""
    return decided.select(
        "doc_id", "source", F.lit(fetch_time).alias("fetch_time"), "modality", "extractor", F.round("gate_quality", 4).alias("gate_quality"),
        F.col("label_name").alias("decision"), F.col("stage").alias("responsible_stage"), F.lit((config or Config()).config_hash()).alias("config_hash"),
    )
