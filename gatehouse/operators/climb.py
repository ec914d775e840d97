"""Hill climbing of gate parameters: two naive regimes, and one that only accepts what the verifier confirms.

The signals of both document sets are computed once and kept, equal ones as one row with their numbers; an iteration is one job over them for all
candidates, and its rows serve the choice, the accept rule and the snapshot. Several regimes over the same documents share what was kept.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut
from gatehouse.operators import verify
from gatehouse.operators.gates import Gate

#: What scores are told apart by.
BY = ("part", "slice", "seed")


@dataclass(frozen=True)
class ClimbConfig:
    iterations: int = 40
    population: int = 8
    step: float = 0.08
    guard_tolerance: float = 0.0
    seed: int = 7
    min_gain: float = 0.005


def perturbed(gate: Gate, rng: random.Random, step: float, most: int | None = None) -> Gate:
    """A copy with one to half of its parameters moved by normal steps, within bounds."""
    bounds = gate.bounds()
    names = list(bounds)
    moved = dict(gate.params())
    for name in rng.sample(names, rng.randint(1, most or max(1, len(names) // 2))):
        low, high = bounds[name]
        moved[name] = min(high, max(low, moved[name] + rng.gauss(0, step * (high - low))))
    return gate.with_params(moved)


class OfflineProposer:
    def __init__(self, seed: int, step: float):
        self.rng, self.step = random.Random(seed), step

    def propose_many(self, gate: Gate, n: int) -> list[Gate]:
        return [perturbed(gate, self.rng, self.step) for _ in range(n)]


class AgenticProposer:
    """Asks a callable (prompt -> text) for parameters as a JSON object; whatever goes wrong falls back to a perturbation."""

    def __init__(self, ask: Callable[[str], str], seed: int = 7):
        self.ask, self.rng, self.failures = ask, random.Random(seed), []

    def propose(self, gate: Gate) -> Gate:
        try:
            answer = self.ask(f"Gate {gate.name}; parameters {json.dumps(gate.params())}; bounds {json.dumps(gate.bounds())}; misjudged: {json.dumps(self.failures)}. Answer with a JSON object of parameters.")
            found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
            bounds = gate.bounds()
            return gate.with_params({k: min(bounds[k][1], max(bounds[k][0], float(v))) for k, v in found.items() if k in bounds})
        except Exception:  # any failure of the proposer costs only its proposal
            return perturbed(gate, self.rng, 0.1, most=1)

    def propose_many(self, gate: Gate, n: int) -> list[Gate]:
        return [self.propose(gate) for _ in range(n)]


@dataclass
class Climb:
    gate: Gate
    regime: str
    trajectory: list[dict]


@dataclass
class Judged:
    """What one job says about candidates: a row for each candidate, part, slice and seed, and their false positives on guard documents."""

    gates: list[Gate]
    rows: list
    rates: dict[int, float] | None
    test: str

    def mean(self, candidate: int, what: str, part: str | None = None, which: str = "heldout") -> float:
        values = [r[what] for r in self.rows if (r["candidate_id"], r["part"], r["slice"]) == (candidate, part or self.test, which)]
        return sum(values) / len(values) if values else 0.0

    def fpr(self, candidate: int) -> float:
        return self.mean(candidate, "fpr") if self.rates is None else self.rates.get(candidate, 0.0)

    def frames(self, spark: SparkSession, candidate: int) -> tuple[DataFrame, DataFrame | None]:
        """Scores and guard rates of the incumbent, 0, and a candidate, for the accept rule."""
        rows = [(r["candidate_id"], r["slice"], r["seed"], r["f1"], r["fpr"]) for r in self.rows if r["part"] == self.test and r["candidate_id"] in (0, candidate)]
        rates = None if self.rates is None else spark.createDataFrame([(c, self.rates.get(c, 0.0)) for c in (0, candidate)], "candidate_id int, guard_fpr double")
        return spark.createDataFrame(rows, "candidate_id int, slice string, seed int, f1 double, fpr double"), rates


@dataclass
class Measured:
    """Signals that any number of climbs from gates with the same signals read: equal rows of the mutation sets and of guard documents, counted by part, slice and seed."""

    tally: DataFrame
    cells: list[tuple[str, str, int]]


#: The cell of guard documents, which are all clean.
GUARD = ("guard", "clean", 0)


def measured(gate: Gate, docs: DataFrame, kind: str, eval_docs: DataFrame | None = None, opt_seeds: Sequence[int] = range(5), test_seeds: Sequence[int] = range(20, 25), ops: Sequence[str] | None = None, guard_docs: DataFrame | None = None) -> Measured:
    slices, sets = ("train", "heldout"), {"own": (docs, opt_seeds), **({} if eval_docs is None else {"test": (eval_docs, test_seeds)})}
    parts = [verify.signals(gate, d, kind, seeds, slices, ops).drop("doc_id").withColumn("part", F.lit(k)) for k, (d, seeds) in sets.items()]
    cells = [(k, w, int(s)) for k, (_, seeds) in sets.items() for w in slices for s in seeds]
    if guard_docs is not None:
        own = {"seed": F.lit(GUARD[2]), "slice": F.lit(GUARD[1]), "defect": F.lit(0), "part": F.lit(GUARD[0])}
        parts.append(gate.prepare(guard_docs).withColumns(own).select(*parts[0].columns))
        cells.append(GUARD)
    tally = cut(verify.tallied(reduce(DataFrame.unionByName, parts), list(gate.weights), cells, BY))
    return Measured(tally.coalesce(max(1, tally.count() // 50_000)), cells)  # many jobs read it: no more tasks than its rows need


def hillclimb(gate: Gate, docs: DataFrame, kind: str, regime: str, config: ClimbConfig | None = None, eval_docs: DataFrame | None = None, opt_seeds: Sequence[int] = range(5), test_seeds: Sequence[int] = range(20, 25), ops: Sequence[str] | None = None, proposer=None, guard_docs: DataFrame | None = None, seen_before: Measured | None = None) -> Climb:
    """Regimes: "naive_recall", "naive_f1" (train slice, strictly better wins), else verified (penalised held-out objective, accepted on eval_docs).

    False positives are held against guard_docs, clean documents of their own; without them against those of eval_docs. A proposer with
    `failures` is told some documents that the gate judges wrongly. seen_before: measured() of the same documents, seeds and operators, for several climbs over them.
    """
    config = config or ClimbConfig()
    proposer = proposer or OfflineProposer(config.seed, config.step)
    test = "own" if eval_docs is None else "test"
    held = seen_before or measured(gate, docs, kind, eval_docs, opt_seeds, test_seeds, ops, guard_docs)
    trajectory = []

    def judged(gates: list[Gate]) -> Judged:
        rows = verify.score_tallied(held.tally, gates, held.cells, BY).collect()  # candidates x parts x slices x seeds
        rates = {r["candidate_id"]: r["fpr"] for r in rows if r["part"] == GUARD[0]} if guard_docs is not None else None
        return Judged(gates, rows, rates, test)

    def snapshot(i: int, seen: Judged, c: int) -> None:
        trajectory.append({"regime": regime, "iter": i, "recall_train": seen.mean(c, "recall", "own", "train"), "f1_heldout": seen.mean(c, "f1"), "guard_fpr": seen.fpr(c)})

    seen, now = judged([gate]), 0
    snapshot(0, seen, 0)
    naive = {"naive_recall": "recall", "naive_f1": "f1"}.get(regime)
    for i in range(1, config.iterations + 1):
        if hasattr(proposer, "failures"):
            proposer.failures = verify.misjudged(gate, docs, kind, config.seed + i, ops)
        seen, now = judged([gate, *proposer.propose_many(gate, config.population)]), 0
        others = range(1, len(seen.gates))
        if naive:
            top = max(others, key=lambda c: seen.mean(c, naive, "own", "train"), default=0)  # the first wins ties
            now = top if seen.mean(top, naive, "own", "train") > seen.mean(0, naive, "own", "train") else 0
        elif others:
            top = max(others, key=lambda c: seen.mean(c, "f1", "own") - 0.5 * seen.mean(c, "fpr", "own"))
            scores, rates = seen.frames(docs.sparkSession, top)
            now = top if verify.accepted(scores, 0, top, delta=config.min_gain, eps=config.guard_tolerance, guard=rates).accept else 0
        gate = seen.gates[now]
        snapshot(i, seen, now)
    return Climb(gate, regime, trajectory)
