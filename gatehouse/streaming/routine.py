"""The daily routine: curate a day's documents, write the ledger, watch throughput and quality, remediate after an alarm.

Each day may change what the next one reads (remediation), so days run one after another; a day itself is distributed. Routine.tick takes a day
as a DataFrame. DailyStream takes days off a stream: what it knows (charts, alarms, days seen) is committed to the ledger's log under the id of
the micro-batch, so a routine that is stopped anywhere goes on as if it hadn't been.
"""

from __future__ import annotations

import statistics
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatehouse.functions.stats import NORMAL
from gatehouse.functions.text import strip
from gatehouse.operators.cascade import curate, provenance
from gatehouse.sources.ledger import Ledger
from gatehouse.streaming.spc import Chart


def simple_reextract(text):
    """Tags to spaces; stripped lines of 1 to 24 characters without a closing mark dropped; addresses removed; lines joined."""
    lines = F.transform(F.split(F.regexp_replace(text, r"<[^>]+>", " "), "\n", -1), strip)
    kept = F.filter(lines, lambda x: (x != "") & ((F.length(x) >= 25) | x.rlike(r"[.?!]$")))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"https?://\S+", "")), " ")


class Harness(Protocol):
    def schedule(self, cron: str, command: str) -> str: ...
    def run_step(self, name: str, payload: dict) -> str: ...
    def report(self, summary: dict) -> None: ...
    def now(self) -> int: ...


@dataclass
class LocalHarness:
    """A logical clock that advances with every reading; summaries go to a ledger of its own, if it has one."""

    ledger: Ledger | None = None
    day: int = -1
    steps: list = field(default_factory=list)
    summaries: list = field(default_factory=list)

    def schedule(self, cron: str, command: str) -> str:
        return f"{cron} {command}"

    def run_step(self, name: str, payload: dict) -> str:
        self.steps.append((name, payload))
        return f"ran {name}"

    def report(self, summary: dict) -> None:
        self.summaries.append(summary)
        if self.ledger is not None:
            self.ledger.append_summary(summary, len(self.summaries))

    def now(self) -> int:
        self.day += 1
        return self.day


@dataclass
class CommandHarness(LocalHarness):
    """Steps run as commands, at most ten minutes each; without the command they do nothing."""

    command: tuple[str, ...] = ()

    def run_step(self, name: str, payload: dict) -> str:
        try:
            return subprocess.run([*self.command, name], input=str(payload), capture_output=True, text=True, timeout=600, check=False).stdout
        except FileNotFoundError:
            return f"no command for {name}"


class Monitor:
    def __init__(self, chart: Chart):
        self.chart, self.mu, self.sigma = chart, 0.0, 1.0
        self.reset()

    def reset(self) -> None:
        self.state = (self.mu, 0.0, 0.0, 0)

    def fit(self, values: list[float]) -> None:
        self.mu = statistics.median(values) if values else 0.0
        mad = statistics.median([abs(v - self.mu) for v in values]) if values else 0.0
        self.sigma = max(1e-9, NORMAL * mad, 0.02 * (abs(self.mu) + 1e-6))
        self.reset()

    def dumped(self) -> dict:
        return {"mu": self.mu, "sigma": self.sigma, "state": self.state}

    def load(self, kept: dict) -> None:
        self.mu, self.sigma, self.state = kept["mu"], kept["sigma"], tuple(kept["state"])

    def update(self, x: float) -> tuple[bool, bool, str]:
        self.state = self.chart.step(self.state, x, self.mu, self.sigma)
        return self.chart.alarms(self.state, self.mu, self.sigma)


@dataclass
class Routine:
    """warmup: days that make the baseline. remediator: DataFrame -> DataFrame, applied from the day after a quality alarm on; it stays on."""

    warmup: int = 10
    remediator: Callable[[DataFrame], DataFrame] | None = None
    ledger: Ledger | None = None
    recovery: float = 0.95

    def __post_init__(self):
        self.quality, self.throughput = Monitor(Chart(watch="down")), Monitor(Chart())
        self.seen: list[tuple[float, float]] = []
        self.remediating = False

    def dumped(self) -> dict:
        """All that a later day depends on, as JSON."""
        return {"quality": self.quality.dumped(), "throughput": self.throughput.dumped(), "seen": self.seen, "remediating": self.remediating}

    def load(self, kept: dict) -> None:
        self.quality.load(kept["quality"])
        self.throughput.load(kept["throughput"])
        self.seen, self.remediating = [tuple(x) for x in kept["seen"]], kept["remediating"]

    def tick(self, harness: Harness, docs: DataFrame) -> dict:
        day = harness.now()
        if self.remediating and self.remediator is not None:
            docs = self.remediator(docs)
        decided, measures = curate(docs), (F.count(F.lit(1)).alias("n"), F.avg("gate_quality").alias("q"))
        if self.ledger is not None:  # measured while it is written
            seen = Observation()
            self.ledger.append(provenance(decided.observe(seen, *measures), f"day-{day}"), day)
            r = seen.get
        else:
            r = decided.agg(*measures).first()
        n, q = float(r["n"] or 0), 1.0 if r["q"] is None else float(r["q"])
        alerts, actions = [], []
        if len(self.seen) < self.warmup:
            self.seen.append((n, q))
            if len(self.seen) == self.warmup:
                self.throughput.fit([x for x, _ in self.seen])
                self.quality.fit([x for _, x in self.seen])
        else:
            ewma, cusum, direction = self.quality.update(q)
            flow = self.throughput.update(n)
            if self.remediating and q >= self.recovery * self.quality.mu:  # recovery comes first and silences the day's alarm
                actions.append("recovered")
                self.quality.reset()
            elif (ewma or cusum) and direction == "down":
                alerts.append("quality_drift_down")
                actions.append("hillclimb")
                harness.run_step("hillclimb", {"day": day, "quality": q})
                self.remediating = True
            if flow[0] or flow[1]:
                alerts.append(f"throughput_drift_{flow[2]}")
        out = {"day": day, "ok": not alerts, "throughput": n, "quality": round(q, 4), "alerts": alerts, "actions": actions}
        harness.report(out)
        return out


STAGED = "day int, doc_id string, text string, source string, modality string, raw string"


@dataclass
class DailyStream:
    """The routine over a stream of documents (STAGED) by days.

    lag: a day is finished once a day so much later was seen; 0: with the first batch that has it, for days that are delivered whole. Days run in
    order, days without documents too. Documents of unfinished days wait as a part of the ledger's log. Those of finished days are late: they get
    decisions in the ledger, under the writer `late`, and are counted in the next summary, but charts aren't drawn anew.

    A micro-batch writes, first, its documents and the decisions of days that it finishes, each as a part that a second attempt replaces; then
    charts, summaries and what is waited for, in one commit. Stopped in between, it is done again from the state before it; stopped after it,
    the commit shows that it is done. Decisions of a day that is done again don't count twice.
    """

    ledger: Ledger
    warmup: int = 10
    remediator: Callable[[DataFrame], DataFrame] | None = None
    recovery: float = 0.95
    lag: int = 1
    name: str = "routine"
    harness: Harness | None = None

    def process(self, batch: DataFrame, batch_id: int) -> None:
        before = self.ledger.reached(self.name)
        if before and before[0] >= batch_id:
            return
        kept = before[1] if before else {"finished": None, "newest": None, "waiting": {}, "routine": None}
        loop = Routine(self.warmup, self.remediator, self.ledger, self.recovery)
        if kept["routine"]:
            loop.load(kept["routine"])
        rows = batch.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in STAGED.split(", ")]).where("day IS NOT NULL")
        finished, newest, waiting = kept["finished"], kept["newest"], dict(kept["waiting"])
        span = rows.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.when(F.col("day") <= finished, 1) if finished is not None else F.lit(None)).alias("late")).first()
        if span["last"] is not None:
            fresh = rows if finished is None else rows.where(F.col("day") > finished)
            self.ledger.stage(fresh.repartitionByRange("day").sortWithinPartitions("day"), self.name, batch_id)
            waiting[str(batch_id)] = span["last"]
            newest = span["last"] if newest is None else max(newest, span["last"])
            finished = span["first"] - 1 if finished is None else finished
        if span["late"]:
            late = Ledger(self.ledger.spark, self.ledger.path, "late")
            late.append(provenance(curate(rows.where(F.col("day") <= finished).drop("day")), f"late-{batch_id}"), batch_id)
        summaries = []
        if newest is not None:
            held = self.ledger.staged(self.name, STAGED)
            for day in range(finished + 1, newest - self.lag + 1):
                harness = self.harness or LocalHarness()
                harness.day = day - 1
                summaries.append(loop.tick(harness, held.where(F.col("day") == day).drop("day")) | {"late": span["late"] if not summaries else 0})
                finished = day
        gone = [b for b, last in waiting.items() if finished is not None and last <= finished]
        after = {"finished": finished, "newest": newest, "waiting": {b: x for b, x in waiting.items() if b not in gone}, "routine": loop.dumped()}
        self.ledger.advance(self.name, batch_id, after, summaries, [(self.name, int(b)) for b in gone])

    def start(self, docs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs over a streaming DataFrame, by default over all that is there now."""
        return docs.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def summaries(self) -> DataFrame:
        """day, ok, throughput, quality, alerts, actions and late of each finished day."""
        made = "day int, ok boolean, throughput double, quality double, alerts array<string>, actions array<string>, late long"
        return self.ledger.records("summary").select(F.from_json("body", made).alias("s")).select("s.*")
