"""Scoring gates against the mutation oracle, and the guarded accept rule.

Signals don't depend on a gate's parameters, so the signals of a mutation set are computed once; any number of candidate
parameter vectors is then one small cross join and one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions import counts
from gatehouse.functions.text import clamp, share
from gatehouse.operators.gates import Gate
from gatehouse.operators.metrics import binary_prf, f1, hits
from gatehouse.operators.mutate import html_counted, mutation_set

# fixed values: multipliers of the standard error by number of pairs; 1.96 beyond
T = {2: 12.706, 3: 4.303, 4: 3.182, 5: 2.776, 6: 2.571, 7: 2.447, 8: 2.365, 9: 2.306, 10: 2.262}


def t_multiplier(n: int) -> float:
    return T.get(n, 1.96)


def signals(gate: Gate, docs: DataFrame, kind: str, seeds: Sequence[int], slices: Sequence[str] = ("heldout",), ops: Sequence[str] | None = None) -> DataFrame:
    """doc_id, seed, slice, defect and the gate's signals over the mutation set. Clean rows are scored once, not once for each seed."""
    cols = [f"s_{k}" for k in gate.weights]
    if kind == "html" and gate.counts is counts.html and not gate.joined:
        return html_counted(docs, seeds, slices, ops).select("doc_id", "seed", "slice", "defect", *[clamp(v).alias(f"s_{k}") for k, v in gate.signals(gate).items()])
    clean = gate.prepare(docs).select("doc_id", *cols)
    pairs = docs.sparkSession.createDataFrame([(int(s), w) for s in seeds for w in slices], "seed int, slice string")
    clean = clean.crossJoin(F.broadcast(pairs)).withColumn("defect", F.lit(0))  # seeds x slices rows
    bad = gate.prepare(mutation_set(docs, kind, seeds, slices, ops, clean=False))
    return clean.select("doc_id", "seed", "slice", "defect", *cols).unionByName(bad.select("doc_id", "seed", "slice", "defect", *cols))


def candidates(spark, gates: Sequence[Gate]) -> DataFrame:
    """candidate_id, w (in signal order), threshold."""
    return spark.createDataFrame([(i, [float(x) for x in g.weights.values()], float(g.threshold)) for i, g in enumerate(gates)], "candidate_id int, w array<double>, threshold double")


def _quality(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a * b, [F.lit(1.0) - clamp(F.greatest(F.lit(0.0), F.element_at("w", i + 1)) * F.col(f"s_{k}")) for i, k in enumerate(names)])


def score(matrix: DataFrame, gates: Sequence[Gate], by: Sequence[str] = ("slice", "seed")) -> DataFrame:
    """precision, recall, f1, fpr and n by candidate, slice and seed, or other columns. The candidates are a list of the driver's, and broadcast."""
    names = list(gates[0].weights)
    rows = matrix.crossJoin(F.broadcast(candidates(matrix.sparkSession, gates))).withColumn("pred", (_quality(names) < F.col("threshold")).cast("int"))
    prf = binary_prf(F.col("pred"), F.col("defect"))
    fp, tn = hits((F.col("pred") == 1) & (F.col("defect") == 0)), hits((F.col("pred") == 0) & (F.col("defect") == 0))
    return rows.groupBy("candidate_id", *by).agg(*[v.alias(k) for k, v in prf.items()], share(fp, fp + tn).alias("fpr"), F.count(F.lit(1)).alias("n"))


def tallied(matrix: DataFrame, names: Sequence[str], cells: Sequence[tuple], by: Sequence[str] = ("slice", "seed")) -> DataFrame:
    """defect, s (the signals) and n, how many rows of each cell, a value of by, have these: equal rows are judged once for all candidates and cells."""
    cell = lambda c: reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(by, c, strict=True)])
    cols = [f"s_{k}" for k in names]
    held = matrix.groupBy("defect", *cols).agg(*[F.count(F.when(cell(c), 1)).alias(f"_{i}") for i, c in enumerate(cells)])
    return held.select("defect", F.array(*cols).alias("s"), F.array(*[F.col(f"_{i}") for i in range(len(cells))]).alias("n"))


def _judged(gates: Sequence[tuple[list[float], float]], cells: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(gates), 2, 2, cells), np.int64)  # candidate, defect, flagged
        for b in batches:
            s = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            n, defect = np.asarray(b.column(2).flatten()).reshape(b.num_rows, cells), np.asarray(b.column(0)) == 1
            every = np.stack([n[~defect].sum(axis=0), n[defect].sum(axis=0)])
            for i, (weights, threshold) in enumerate(gates):
                quality = np.ones(b.num_rows)
                for k, w in enumerate(weights):
                    quality *= 1.0 - np.clip(max(0.0, w) * s[:, k], 0.0, 1.0)
                hit = quality < threshold
                flagged = np.stack([n[hit & ~defect].sum(axis=0), n[hit & defect].sum(axis=0)])
                found[i, :, 1] += flagged
                found[i, :, 0] += every - flagged
        at = np.indices((len(gates), cells)).reshape(2, -1).astype(np.int32)
        counts = [found[:, d, f].ravel() for d, f in ((1, 1), (0, 1), (1, 0), (0, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, *counts)], names=["candidate_id", "cell", "tp", "fp", "fn", "tn"])

    return run


def score_tallied(tally: DataFrame, gates: Sequence[Gate], cells: Sequence[tuple], by: Sequence[str] = ("slice", "seed")) -> DataFrame:
    """score() of what tallied() holds; a task sends a row for each candidate and cell."""
    made = tally.select("defect", "s", "n").mapInArrow(_judged([([float(w) for w in g.weights.values()], float(g.threshold)) for g in gates], len(cells)), "candidate_id int, cell int, tp long, fp long, fn long, tn long")
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    one = made.groupBy("candidate_id", "cell").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "tn")]).withColumn("n", tp + fp + fn + tn).where("n > 0")
    named = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(by, c, strict=True)]) for c in cells])
    rates = {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": f1(tp, fp, fn), "fpr": share(fp, fp + tn)}
    return one.withColumn("_at", F.get(named, F.col("cell"))).select("candidate_id", "_at.*", *[v.alias(k) for k, v in rates.items()], "n")


def floor_and_upper(matrix: DataFrame, gate: Gate) -> DataFrame:
    """Mean F1 over seeds by slice: heldout is the floor, train the upper bound."""
    return score(matrix, [gate]).groupBy("slice").agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.avg("fpr").alias("fpr"))


def guard_fpr(gate: Gate, clean: DataFrame) -> DataFrame:
    """Share of clean documents that the gate flags; 0 of none."""
    return gate.evaluate(clean).agg(F.coalesce(F.avg((~F.col("gate_passed")).cast("double")), F.lit(0.0)).alias("guard_fpr"))


def objective(scores: DataFrame, which: str = "heldout", penalty: float = 0.5) -> DataFrame:
    """Mean F1 less half the false positive rate, by candidate."""
    return scores.where(F.col("slice") == which).groupBy("candidate_id").agg(F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.avg("fpr").alias("fpr"), (F.avg("f1") - penalty * F.avg("fpr")).alias("objective"))


@dataclass(frozen=True)
class Accept:
    accept: bool
    delta_f1: float
    lower_bound: float
    delta_fpr: float
    reason: str


def guard_rates(guard: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """candidate_id and guard_fpr: the share of clean documents that each candidate flags. guard: signals of clean documents, as of Gate.prepare()."""
    names = list(gates[0].weights)
    rows = guard.crossJoin(F.broadcast(candidates(guard.sparkSession, gates)))
    return rows.groupBy("candidate_id").agg(F.avg((_quality(names) < F.col("threshold")).cast("double")).alias("guard_fpr"))


def misjudged(gate: Gate, docs: DataFrame, kind: str, seed: int, ops: Sequence[str] | None = None, limit: int = 4) -> list[str]:
    """The beginnings of some documents that the gate judges wrongly, for a proposer to read."""
    seen = gate.evaluate(mutation_set(docs, kind, [seed], ("heldout",), ops)).where(F.col("gate_passed") == (F.col("defect") == 1))
    rows = seen.select("defect", F.substring(F.coalesce("raw", "text") if kind == "json" else F.col("text"), 1, 160).alias("t")).limit(limit).collect()
    return [("missed defect: " if r["defect"] else "false alarm: ") + r["t"] for r in rows]


def accept_rule(scores: DataFrame, incumbent: int, candidate: int, which: str = "heldout", delta: float = 0.005, eps: float = 0.005, guard: DataFrame | None = None) -> DataFrame:
    """One row: the paired gain over seeds, its lower bound, the change in false positives, and the verdict. guard: guard_rates() to hold false
    positives against instead of those of the scores."""
    side = lambda c, p: [F.max(F.when(F.col("candidate_id") == c, F.col(k))).alias(f"{k}_{p}") for k in ("f1", "fpr")]
    both = scores.where((F.col("slice") == which) & F.col("candidate_id").isin(incumbent, candidate))  # in one reading, which makes the scores
    pair = both.groupBy("seed").agg(*side(incumbent, "a"), *side(candidate, "b")).where("f1_a IS NOT NULL AND f1_b IS NOT NULL").withColumn("d", F.col("f1_b") - F.col("f1_a"))
    one = pair.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("delta_f1"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"), F.coalesce(F.avg("fpr_b") - F.avg("fpr_a"), F.lit(0.0)).alias("delta_fpr"))
    if guard is not None:
        rate = lambda c: F.max(F.when(F.col("candidate_id") == c, F.col("guard_fpr")))
        one = one.drop("delta_fpr").crossJoin(F.broadcast(guard.agg(F.coalesce(rate(candidate) - rate(incumbent), F.lit(0.0)).alias("delta_fpr"))))  # one row
    t = F.coalesce(F.create_map(*[x for k, v in T.items() for x in (F.lit(k), F.lit(v))])[F.col("n").cast("int")], F.lit(1.96))
    bound = F.col("delta_f1") - t * F.coalesce(F.col("sd") / F.sqrt(F.nullif(F.col("n"), F.lit(0))), F.lit(0.0))
    gain, guard = F.col("lower_bound") > delta, F.col("delta_fpr") <= eps
    reason = F.when(gain & guard, "ok").when(~gain, "gain not significant").otherwise("FPR regression")
    return one.withColumn("lower_bound", bound).select((gain & guard).alias("accept"), "delta_f1", "lower_bound", "delta_fpr", reason.alias("reason"))


def accepted(scores: DataFrame, incumbent: int, candidate: int, **rule) -> Accept:
    return Accept(**accept_rule(scores, incumbent, candidate, **rule).first().asDict())
