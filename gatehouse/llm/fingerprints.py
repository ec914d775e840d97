"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every length, the polynomial hash of that prefix modulo the prime 2**31 - 1 for
two bases. The hash of any span is a difference of two entries, so equality of two spans costs O(1) and the longest
common extension of two positions is found by binary search. A fingerprint is the whole text's length and hash,
followed by the smallest `SKETCH` mixed hashes of its `SPAN`-character spans (a bottom-k sketch); the likeness of two
fingerprints is the Jaccard estimate of their span sets.

Nulls, empty and very long texts: null counts as empty; an empty text has the length 0, the hash 0 and no spans,
and is alike (1.0) only to another empty text; a text shorter than a span has itself as its only span. Repeated
doc_id: rows are ordered by (doc_id, text), null doc_id first, and every row is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 715_827_883)
SPAN, SKETCH = 16, 64
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_edited long, common_prefix_next long"


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x < 2**63, in place."""
    _fold(_fold(x))
    return np.minimum(x, x - PRIME, out=x)  # below the prime, x - PRIME wraps to a larger value


def _fold(x: np.ndarray) -> np.ndarray:
    """The same residue below 2**33, in place."""
    high = x >> np.uint64(31)
    x &= PRIME
    x += high
    return x


class Bases:
    """Powers of each base and of its inverse modulo the prime, made as far as needed."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def reach(self, n: int) -> None:
        while len(self.up[0]) < n:
            for table, roots in ((self.up, BASES), (self.down, [pow(b, -1, int(PRIME)) for b in BASES])):
                for k, b in enumerate(roots):
                    have = table[k]
                    table[k] = np.concatenate([have, _mod(have * np.uint64(pow(b, len(have), int(PRIME))))])


_bases = Bases()


class PrefixHash:
    """Prefix hashes of one text: span(i, j) for equality of spans, lce() for longest common extensions."""

    def __init__(self, codes: np.ndarray, start: PrefixHash | None = None, keep: int = 0):
        """codes: code points. With start, the first `keep` entries are those of another prefix array and codes are what follows."""
        n = keep + len(codes)
        _bases.reach(n + 1)
        self.n, self.h = n, []
        c = codes.astype(np.uint64) + np.uint64(1)
        for k in range(len(BASES)):
            head = start.h[k][: keep + 1] if start is not None else np.zeros(1, np.uint64)
            own = np.empty(n + 1, np.uint64)
            own[: keep + 1] = head
            tail = own[keep + 1 :]
            np.cumsum(_fold(c * _bases.up[k][keep:n]), out=tail)
            tail += head[-1]
            _mod(tail)
            self.h.append(own)

    def spans(self, width: int, start: int = 0) -> np.ndarray:
        """Mixed 32-bit hashes, by the first base, of all spans of a width from `start` on; their values do not depend on where they start."""
        h, m = self.h[0], self.n - width + 1
        x = h[start + width :] + PRIME
        x -= h[start:m]
        x *= _bases.down[0][start:m]
        return (common.mix64(_mod(x)) >> np.uint64(32)).astype(np.uint32)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        p = int(PRIME)
        return tuple((int(h[j]) - int(h[i])) % p * int(down[i]) % p for h, down in zip(self.h, _bases.down, strict=True))

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def lce(self, i: int, other: PrefixHash, j: int, known: int = 0) -> int:
        """Length of the longest common extension of position i here and j there, of which `known` is given: by doubling, then binary search."""
        low, most, step = known, min(self.n - i, other.n - j), 1
        while low + step <= most and self.equal(i + low, other, j + low, step):
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def hashes(self, other: np.ndarray | None = None, shared: int = 0) -> np.ndarray:
        """All span hashes; those within the first `shared` characters are taken from `other`."""
        if not self.n:
            return np.zeros(0, np.uint32)
        if other is None or self.n < SPAN or shared < SPAN:
            return self.spans(min(SPAN, self.n))
        same = shared - SPAN + 1
        return np.concatenate([other[:same], self.spans(SPAN, same)])

    def fingerprint(self, sketch: np.ndarray) -> str:
        return f"{self.n:08x}{int(self.h[0][-1]):08x}{int(self.h[1][-1]):08x}" + sketch.astype(">u4").tobytes().hex()


def smallest(v: np.ndarray) -> np.ndarray:
    """The smallest distinct span hashes, sorted."""
    m = 2 * SKETCH
    while True:
        low = np.partition(v, m - 1)[:m] if m < len(v) else v.copy()
        low.sort()
        if len(low):
            low = low[np.concatenate([[True], low[1:] != low[:-1]])]
        if len(low) >= SKETCH or m >= len(v):
            return low[:SKETCH]
        m *= 8


def parse(fingerprint: str) -> tuple[str, np.ndarray]:
    return fingerprint[:24], np.frombuffer(bytes.fromhex(fingerprint[24:]), ">u4").astype(np.uint32)


def _alike(head_a: str, a: np.ndarray, head_b: str, b: np.ndarray) -> float:
    if head_a == head_b:
        return 1.0
    both = np.concatenate([a, b])
    if not len(a) or not len(b):
        return 0.0
    both.sort()
    twice = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~twice])
    first = both[distinct][:SKETCH] if len(a) >= SKETCH or len(b) >= SKETCH else both[distinct]
    return float((both[1:][twice] <= first[-1]).sum()) / len(first)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness, from 0 to 1, of two fingerprints' span sets; equal fingerprints are 1."""
    (ha, sa), (hb, sb) = parse(a), parse(b)
    return _alike(ha, sa, hb, sb)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Doc:
    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.prefix = PrefixHash(codes(text))
        self.hashes = self.prefix.hashes()
        self.sketch = smallest(self.hashes)
        self.print = self.prefix.fingerprint(self.sketch)


def _pair(doc: _Doc, following: _Doc) -> tuple:
    n = len(doc.text)
    k = n // 4
    tail = following.text[:k]
    edited = doc.text[: n - k] + tail
    if edited == doc.text:
        prefix, sketch = doc.prefix, doc.sketch
    else:
        prefix = PrefixHash(codes(tail), doc.prefix, n - k)
        sketch = smallest(prefix.hashes(doc.hashes, n - k))
    mark = prefix.fingerprint(sketch)
    return (doc.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), doc.print, mark, _alike(doc.print[:24], doc.sketch, mark[:24], sketch), _alike(doc.print[:24], doc.sketch, following.print[:24], following.sketch), doc.prefix.lce(0, prefix, 0, n - k), doc.prefix.lce(0, following.prefix, 0))


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, is_halo, doc_id, text): a bucket's own rows, then the first row of the next bucket that has any."""
    last, last_bucket, out = None, None, []

    def made() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix_edited", pa.int64()), ("common_prefix_next", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    for batch in batches:
        ids, buckets, halos, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "bucket", "is_halo", "text"))
        for i in range(batch.num_rows):
            bucket, halo = buckets[i].as_py(), halos[i].as_py()
            if halo and last_bucket != bucket:
                continue  # a second halo row (repeated first id), or a bucket without rows
            doc = _Doc(ids[i].as_py(), texts[i].as_py() or "")
            if last is not None and last_bucket == bucket:
                out.append(_pair(last, doc))
                if len(out) >= 512:
                    yield made()
                    out = []
            last, last_bucket = (None, None) if halo else (doc, bucket)
    if out:
        yield made()


def _buckets(ids: DataFrame, n: int) -> list:
    """Lower bounds of buckets by quantiles of doc_id, at most n - 1 distinct values."""
    if n <= 1:
        return []
    row = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n + 1000).alias("q")).first()
    return sorted(set(row["q"] or []))


def fingerprint_documents(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter replaced by the next document's first characters).

    The text is shuffled once, into buckets by ranges of doc_id; each bucket also gets the first document of the next
    one, which is all that crosses a boundary. What the driver reads is a bound and a smallest id for each bucket.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = n_buckets or common.partitions(spark)
    bounds = _buckets(base.select("doc_id"), n)
    bucket = F.lit(0)
    if bounds:
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket_expr(bounds))
    rows = base.withColumn("bucket", bucket.cast("int"))
    # "the smallest row of each bucket" by (doc_id, text): a null id is below all others and lives in bucket 0
    low = rows.select("doc_id", "bucket").groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect()
    firsts = {r["bucket"]: None if r["has_null"] else r["low"] for r in low}
    order = sorted(firsts)
    before = {order[(k + 1) % len(order)]: order[k] for k in range(len(order))}  # whose halo a bucket's first row is
    first_of = F.lit(False)
    target = F.lit(None).cast("int")
    if order:
        entries = [x for b in order for x in (F.lit(b), F.lit(firsts[b]).cast("long"))]
        prev = [x for b in order for x in (F.lit(b), F.lit(before[b]))]
        first_of = F.col("doc_id").eqNullSafe(F.create_map(*entries)[F.col("bucket")])
        target = F.create_map(*prev)[F.col("bucket")]
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("is_halo"))
    copy = F.struct(target.alias("bucket"), F.lit(True).alias("is_halo"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(first_of, F.array(own, copy)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "to.bucket", "to.is_halo")
    placed = dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "is_halo", F.col("doc_id").asc_nulls_first(), "text")
    return placed.mapInArrow(_in_order, SCHEMA)


def _bucket_expr(bounds: list):
    """The number of bounds that are not above doc_id, by a binary search written as nested conditions."""

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))
