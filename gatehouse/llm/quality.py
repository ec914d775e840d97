"""Document quality by positive-unlabelled learning.

Trusted positives are texts labelled as good; unlabelled text is a draw from all documents of the fitting folds, whatever
their labels. A small network g is fitted to the non-negative unbiased risk
    pi R+(g; positives) + max(0, R-(g; unlabelled) - pi R-(g; positives)),
with the logistic loss. The class prior pi is estimated without negatives: a first network tells positives from unlabelled texts on one half of
both, and on the other half pi is the least ratio, over score limits, of the share of unlabelled texts above the limit to that of
positives, where both shares are large enough to be sure of.
Inputs are shares of characters, words and lines of the text alone: never labels, lang, source or doc_id.

Fitting uses at most `FIT_ROWS` positives and as many unlabelled texts, drawn by hash, a documented bound; every text is
scored whole, however long; of a repeated doc_id one row is fitted on. One task fits the model, and the driver gets the model alone. Folds: rows whose crc32(doc_id as text) mod 3 is 1 are held out of labels and of unlabelled draws. Null texts
count as empty; an empty text has all shares 0 and a score like any other. A null doc_id is never fitted on and isn't held
out. Without positives every score is 0.5. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common
from gatehouse.llm.toxicity import labelled, words

FIT_ROWS, HIDDEN, STEPS, SEED = 20_000, 24, 1500, 11

#: Which of the counted classes a byte belongs to: capitals, small letters, digits, bytes of other letters, or itself.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_own = [b for b in range(128) if _CLASS[b] == 0 and (32 <= b < 127 or b in (9, 10, 13))]
_CLASS[_own] = np.arange(5, 5 + len(_own))
CLASSES = 5 + len(_own)


def _distinct_share(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct values by text over values by text; 1 without values. h: values in order of texts."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, text))
    a, t = h[order], text[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    return np.where(counts > 0, np.bincount(t[new], minlength=len(counts)) / np.maximum(counts, 1), 1.0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: its length, roots of byte class shares, word shape, and how much of words, word pairs and lines is new."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    share = np.bincount(text * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
    h, off = words(data, offsets)
    count = np.diff(off)
    pair = np.zeros(0, np.uint64)
    pairs = np.maximum(count - 1, 0)
    if len(h) > 1:
        inside = np.ones(len(h), bool)
        inside[off[1:][count > 0] - 1] = False
        pair = common.mix64(h[:-1] * np.uint64(3) + h[1:])[inside[:-1]]
    letters = share[:, 1] + share[:, 2] + share[:, 4]
    capital = share[:, 1] / np.maximum(letters, 1e-9)
    extra = [np.log1p(size), np.log1p(count), size * letters / np.maximum(count, 1) / 10, capital, _distinct_share(h, count), _distinct_share(pair, pairs)]
    return np.column_stack([np.sqrt(share), *extra])


@dataclass(frozen=True)
class Net:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        v = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(np.tanh(v @ self.w1 + self.b1) @ self.w2 + self.b2, -40, 40)))


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positive part of the risk, the negative one (which must not stay below 0), and what to descend along, by gp and gu: the gradient of their sum,
    or where the negative part is below 0 its own, turned, as the method has it."""
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    rise = np.concatenate([-prior * _sig(gp) / len(gp), _sig(gu) / len(gu)])  # of the negative part
    if negative < 0:
        return positive, negative, -rise
    rise[: len(gp)] -= prior * _sig(-gp) / len(gp)
    return positive, negative, rise


def apart(gp: np.ndarray, gu: np.ndarray, _: float) -> tuple[float, float, np.ndarray]:
    """The logistic loss of positives against unlabelled texts, each half of it, and its gradient."""
    return np.logaddexp(0, -gp).mean() / 2, np.logaddexp(0, gu).mean() / 2, np.concatenate([-_sig(-gp) / len(gp), _sig(gu) / len(gu)]) / 2


def _train(positive: np.ndarray, unlabelled: np.ndarray, risk, prior: float, steps: int) -> Net:
    """Adam on batches, along what risk says."""
    rng = np.random.default_rng(SEED)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = p.shape[1]
    theta = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), min(512, len(p)))], u[rng.integers(0, len(u), min(1024, len(u)))]
        x = np.concatenate([xp, xu])
        hid = np.tanh(x @ theta[0] + theta[1])
        g = hid @ theta[2] + theta[3]
        dg = risk(g[: len(xp)], g[len(xp) :], prior)[2]
        dh = np.outer(dg, theta[2]) * (1 - hid * hid)
        grads = [x.T @ dh + 1e-4 * theta[0], dh.sum(axis=0), hid.T @ dg + 1e-4 * theta[2], np.array([dg.sum()])]
        rate = 0.01 * (1 - step / (steps + 1))
        for k, gr in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * gr
            v[k] = 0.999 * v[k] + 0.001 * gr * gr
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Net(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS // 3, sure: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from both alone. Every second row trains, the others are counted."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    net = _train(positive[::2], unlabelled[::2], apart, 0.5, steps)
    sp, su = np.sort(net.score(positive[1::2])), np.sort(net.score(unlabelled[1::2]))
    limit = np.unique(sp)
    qp = 1 - np.searchsorted(sp, limit) / len(sp)
    qu = 1 - np.searchsorted(su, limit) / len(su)
    wide = np.sqrt(np.log(4 / sure) / 2) * (len(su) ** -0.5 + len(sp) ** -0.5)  # how far the shares may be off
    best = ((qu + wide) / qp).argmin()
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Net:
    """Minimises the non-negative risk."""
    return _train(positive, unlabelled, pu_risk, prior, steps)


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = common.utf8(b.column(1))
        for lo, hi in common.passes(offsets):
            x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2).slice(lo, hi - lo)], names=["y", "x", "doc_id"])


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


MODEL = "mean binary, scale binary, w1 binary, b1 binary, w2 binary, b2 double"


def _fit_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((y, x) for b in batches for y, x in zip(*(c.to_pylist() for c in b.columns), strict=True))  # the same sums in any order of arrival
    good = sum(y for y, _ in rows)
    if not 0 < good < len(rows):
        return
    every = np.frombuffer(b"".join(x for _, x in rows), np.float64).reshape(len(rows), -1)
    every = every[np.concatenate([np.random.default_rng(SEED).permutation(len(rows) - good), len(rows) - good + np.random.default_rng(SEED).permutation(good)])]
    u, p = every[: len(rows) - good], every[len(rows) - good :]
    net = fit(p, u, estimated_prior(p, u))
    yield pa.RecordBatch.from_arrays([*(pa.array([getattr(net, k).tobytes()], pa.binary()) for k in ("mean", "scale", "w1", "b1", "w2")), pa.array([net.b2])], names=[x.split()[0] for x in MODEL.split(", ")])


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Net | None:
    docs = docs.where("doc_id is not null").where(fold(F.col("doc_id")) != 1)
    labels = labels.where(fold(F.col("doc_id")) != 1)
    good = labelled(docs, labels.where("quality = 1"), "quality", limit)
    drawn = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(limit).withColumn("y", F.lit(0))
    other = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    key = F.col("doc_id").cast("string").alias("doc_id")
    rows = good.select("y", "text", key).unionByName(other.select("y", "text", key)).mapInArrow(_featured, "y int, x binary, doc_id string")
    once = rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("y", "x")
    row = once.repartition(1).mapInArrow(_fit_task, MODEL).first()
    if row is None:
        return None
    mean, scale, w1, b1, w2 = (np.frombuffer(row[k], np.float64) for k in ("mean", "scale", "w1", "b1", "w2"))
    return Net(mean, scale, w1.reshape(len(mean), -1), b1, w2, row["b2"])


def _scorer(net: Net | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = common.utf8(b.column(2))
            for lo, hi in common.passes(offsets):
                s = np.full(hi - lo, 0.5) if net is None else net.score(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scorer(net), "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
