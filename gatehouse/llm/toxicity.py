"""Toxicity by cumulative-link ordinal regression on sparse word features.

Grades are ordered: 0 harmless, 1 mild, 2 severe. P(grade > k) = sigmoid(w . x - theta_k) with one weight vector for all
thresholds; the expected severity is the sum of these over k. Features are words (letter runs, ASCII lower-cased) and their
beginnings of 5 and 7 bytes, since inflected languages vary endings, known by 64-bit hash. A text has, or hasn't, at least
1, 2 or 4 of each, or at least 2 that are 1/300 or 1/100 of its words. Features are kept that occur in enough labelled texts and
lean to toxic ones.

Labels mark texts as toxic or not; how severe a toxic one is they don't say. The stand-in for that is held out: the labelled texts are parted
in two by hash, a two-grade model is fitted on each part, and a toxic text has grade 2 where the other part's model scores it above the median
of the toxic texts of its part, else 1. The model is fitted on at most `FIT_ROWS` labelled rows, drawn by a hash of doc_id, a
documented bound, of each doc_id one; scoring reads every text whole. Without labels, or with one class only, the model has no words and
rejects nothing.

Null and empty texts have no words and are scored by the thresholds alone, very long texts in one pass. Repeated rows are scored each; ties in the
draw are broken by doc_id; an empty table gives no rows; a label repeated
for a doc_id counts once, its largest value; a null label isn't used. Extra columns pass through filter_toxic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

FIT_ROWS, FEATURES = 8_000, 4096
#: A text is rejected from this probability of any toxicity on: below even odds, since a missed toxic text costs more.
REJECT = 0.3
BEGINNINGS = (5, 7)
#: Levels of a feature: least count, and least share of the words as one of so many (0: any).
LEVELS = ((1, 0), (2, 0), (4, 0), (2, 300), (2, 100))
#: A feature occurs in so many fitted texts at least, its share is higher among toxic ones by so many standard errors, and of the texts
#: that have it so many are toxic: words that are merely more frequent in long texts, or in one often copied, stay out.
MIN_TEXTS, MIN_Z, MIN_SHARE = 3, 4.0, 0.7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = common.Powers()


def words(data: np.ndarray, offsets: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words of texts in order, and the offsets by text. With beginnings, those of longer words are among them, and each text's number of words comes third."""
    n = len(data)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | cut[:n]))
    ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | cut[1:])) + 1
    up, down = _powers.reach(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    size = ends - starts
    own = [common.mix64((prefix[ends] - prefix[starts]) * down[starts] + size.astype(np.uint64))]
    off = np.searchsorted(starts, offsets)
    if not beginnings:
        return own[0], off
    place = [np.arange(len(starts), dtype=np.int64)]
    for k in beginnings:
        at = np.flatnonzero(size > k)
        own.append(common.mix64((prefix[starts[at] + k] - prefix[starts[at]]) * down[starts[at]] + np.uint64(1000 + k)))
        place.append(at)
    place = np.concatenate(place)
    order = np.argsort(place, kind="stable")
    return np.concatenate(own)[order], np.searchsorted(place[order], off), np.diff(off)


def _has(level: int, count: np.ndarray, size: np.ndarray) -> np.ndarray:
    least, of = LEVELS[level]
    return (count >= least) & ((count * of >= size) if of else True)


@dataclass(frozen=True)
class Ordinal:
    """keys: sorted hashes; weights: by key and level; thresholds ascending."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def totals(self, h: np.ndarray, text: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
        """w . x by text. h: features with the text and the count of each; size: words by text."""
        total, n = np.zeros(len(size)), len(self.keys)
        if n and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), n - 1)
            hit = np.flatnonzero(self.keys[at] == h)
            pair, where = np.unique(text[hit] * np.int64(n) + at[hit], return_inverse=True)
            times = np.bincount(where, weights=count[hit], minlength=len(pair))
            for k in range(len(LEVELS)):
                some = pair[_has(k, times, size[pair // n])]
                np.add.at(total, some // n, self.weights[some % n, k])
        return total

    def above(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) by text and k."""
        if len(data):
            h, off, size = words(data, offsets, BEGINNINGS)
            text = np.searchsorted(off, np.arange(len(h)), side="right") - 1
            total = self.totals(h, text, np.ones(len(h), np.int64), size)
        else:
            total = np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - total[:, None], -60, 60)))


def _none() -> Ordinal:
    return Ordinal(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS))), np.array([20.0, 21.0]))


def loss(s: np.ndarray, theta: float, gap: float, grade: np.ndarray, grades: int) -> tuple[float, np.ndarray, float, float]:
    """Mean of -log P(grade), and its derivatives by each s, by the first threshold and by the logarithm of the gap to the second (none of two grades)."""
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    n, a = len(s), sig(s - theta)  # P(> 0)
    b = sig(s - theta - np.exp(gap)) if grades == 3 else np.zeros(n)  # P(> 1)
    p = np.maximum(np.choose(grade, [1 - a, a - b, b]), 1e-9)
    da, db = a * (1 - a), b * (1 - b)
    ds = np.choose(grade, [da, db - da, -db]) / p / n
    dgap = float((np.choose(grade, [np.zeros(n), -db, db]) / p).mean() * np.exp(gap))
    return float(-np.log(p).mean()), ds, float(-ds.sum()), dgap


def _descend(t: np.ndarray, c: np.ndarray, width: int, grade: np.ndarray, grades: int, steps: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam. t, c: which text has which feature."""
    x, rows = np.concatenate([np.zeros(width), [1.0, 0.0]]), len(grade)
    m = [np.zeros(width + 2), np.zeros(width + 2)]
    for step in range(1, steps + 1):
        _, ds, dtheta, dgap = loss(np.bincount(t, weights=x[c], minlength=rows), x[-2], x[-1], grade, grades)
        g = np.concatenate([np.bincount(c, weights=ds[t], minlength=width) + decay * x[:-2], [dtheta, dgap]])
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.999 * m[1] + 0.001 * g * g
        x = x - 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return x[:-2], np.array([x[-2], x[-2] + np.exp(x[-1])])


def _flat(rows: list) -> tuple[np.ndarray, ...]:
    """Features of all rows, the row and the count of each, and the words by row."""
    sizes = [len(r[1]) for r in rows]
    return np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows), dtype=np.int64), sizes), np.concatenate([r[2] for r in rows]).astype(np.int64), np.array([r[3] for r in rows], np.int64)


def _model(rows: list, y: np.ndarray, grade: np.ndarray, steps: int, decay: float) -> Ordinal:
    """A model of the features that lean to y = 1, of as many grades as occur."""
    if len(rows) < 4 or y.min() == y.max():
        return _none()
    h, text, counts, size = _flat(rows)
    vocab, inv = np.unique(h, return_inverse=True)
    n1, n0 = y.sum(), (1 - y).sum()
    at, column, names = [], [], []
    for k in range(len(LEVELS)):
        some = np.flatnonzero(_has(k, counts, size[text]))
        t, v = text[some], inv[some]
        df = np.bincount(v, minlength=len(vocab))
        df1 = np.bincount(v, weights=y[t], minlength=len(vocab))
        p = df / len(rows)
        z = (df1 / n1 - (df - df1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        ok = np.flatnonzero((df >= MIN_TEXTS) & (z >= MIN_Z) & (df1 >= MIN_SHARE * df))
        ok = ok[np.argsort(-np.abs(z[ok]), kind="stable")[: FEATURES // len(LEVELS)]]
        number = np.full(len(vocab), -1)
        number[ok] = np.arange(len(ok)) + len(names)
        keep = number[v] >= 0
        at.append(t[keep])
        column.append(number[v][keep])
        names += [(int(i), k) for i in ok]
    if not names:
        return _none()
    w, thresholds = _descend(np.concatenate(at), np.concatenate(column), len(names), grade, int(grade.max()) + 1, steps, decay)
    used = np.unique([i for i, _ in names])
    weights = np.zeros((len(used), len(LEVELS)))
    for (i, k), x in zip(names, w, strict=True):
        weights[np.searchsorted(used, i), k] = x
    return Ordinal(vocab[used], weights, thresholds)


def severity(rows: list, y: np.ndarray, steps: int, decay: float) -> np.ndarray:
    """Grades: 0 of y = 0; of the others 2 where the model of the other part scores above the median of their part, else 1."""
    part = np.array([zlib.crc32(r[1].tobytes()) & 1 for r in rows])
    grade = y.copy()
    for k in (0, 1):
        toxic, other = np.flatnonzero((part == k) & (y == 1)), np.flatnonzero(part != k)
        if len(toxic) and len(other):
            model = _model([rows[i] for i in other], y[other], y[other], steps, decay)
            s = model.totals(*_flat([rows[i] for i in toxic]))
            grade[toxic] += s > np.median(s)
    return grade


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, int]], steps: int = 800, decay: float = 1e-5) -> Ordinal:
    """rows: 0 or 1, sorted distinct hashes, their counts and the number of words, of each labelled text. Copies count once."""
    rows = list({(r[0], r[1].tobytes(), r[2].tobytes()): r for r in rows}.values())
    y = np.array([r[0] for r in rows], np.int64)
    if len(rows) < 4 or y.min() == y.max():
        return _none()
    return _model(rows, y, severity(rows, y, steps // 3, decay), steps, decay)


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = common.utf8(b.column(1))
        for lo, hi in common.passes(offsets):
            h, off, size = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], BEGINNINGS)
            bags = [np.unique(h[i:j], return_counts=True) for i, j in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([x.tobytes() for x, _ in bags], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in bags], pa.binary()), pa.array(size)], names=["y", "doc_id", "words", "counts", "size"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, limit: int = FIT_ROWS) -> DataFrame:
    """At most `limit` labelled documents as (doc_id, y, text), drawn by a hash of doc_id; the drawn ids are small enough to broadcast."""
    y = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    drawn = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")


def _fit_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bags = [(y, np.frombuffer(w, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64), k) for b in batches for y, w, n, k in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    bags.sort(key=lambda r: (r[0], r[1].tobytes()))  # the same sums in any order of arrival
    m = fit(bags)
    yield pa.RecordBatch.from_arrays([pa.array([m.keys.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.thresholds.tobytes()], pa.binary())], names=["keys", "weights", "thresholds"])


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Ordinal:
    """The model of at most `limit` labelled documents. One task fits it, of rows whose number is bounded; the driver gets only the model."""
    bags = labelled(docs, labels, "toxic", limit).select("y", "text", F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(_bags, "y int, doc_id string, words binary, counts binary, size long")
    once = bags.groupBy("doc_id").agg(F.min(F.struct("y", "words", "counts", "size")).alias("r")).select("r.*")  # of a repeated doc_id one row
    row = once.repartition(1).mapInArrow(_fit_task, "keys binary, weights binary, thresholds binary").first()
    if row is None:
        return _none()
    return Ordinal(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["weights"], np.float64).reshape(-1, len(LEVELS)), np.frombuffer(row["thresholds"], np.float64))


def _scorer(model: Ordinal, reject: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = common.utf8(b.column(b.num_columns - 1))
            for lo, hi in common.passes(offsets):
                above = model.above(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= reject)],
                    names=[*b.schema.names[:-1], "expected_severity", "grade", "p_toxic", "toxic"],
                )

    return run


def score(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """doc_id, expected_severity (0 to 2), grade, p_toxic and toxic of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scorer(model, reject), "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def filter_toxic(docs: DataFrame, model: Ordinal, reject: float = REJECT) -> DataFrame:
    """The rows of docs that aren't toxic, all columns kept; the verdict is one pass over the texts, without a join."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = common.utf8(b.column(b.schema.get_field_index("text")))
            for lo, hi in common.passes(offsets):
                above = model.above(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield b.slice(lo, hi - lo).filter(pa.array(above[:, 0] < reject))

    return docs.mapInArrow(keep, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
