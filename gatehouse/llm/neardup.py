"""Near-duplicate documents by a chosen-path similarity join on sets of word shingles.

A document is the set of its distinct five-word shingles (ASCII letters lower-cased; words end at ASCII white space);
with fewer words the whole sequence is one shingle; without words the set is empty and linked with nothing. Two
documents are linked when 100 * |A and B| >= threshold * |A or B|, counted on full sets.

How links are found. Equal sets collapse to one class first. Then `TREES` independent trees branch classes by minwise
tokens: the root of a tree chooses one of `COORDINATES` minhash coordinates, its children hold the classes that agree
there, and a node that is still large chooses two more coordinates for children of its own. A pair of similarity s stays
together in a child with probability s, and with two branches at each level (2s > 1) it survives to any depth: at
s = 0.8 a tree separates it with probability below 0.26, all eight trees below 3e-5. In every first node the classes are
compared with the node's first one, and connected components are formed. Nodes that are one component are settled.
Others that are small enough for a task (`LEAF_ROWS` classes, `LEAF_SHINGLES` shingles) are compared exhaustively between
components: on minhash signatures first, where what is far below the threshold drops out, then on full sets as bit rows.
Larger nodes branch; those still large after `LEVELS` levels, which hold classes alike in all chosen coordinates, are dealt to
blocks, and every two blocks are compared exhaustively in a task of their own.

A null text counts as empty, very long texts are compared on their whole sets, repeated rows are equal documents, of equal documents the
smallest doc_id is kept, extra columns are ignored, an empty table gives no rows.
A row without doc_id takes part in no link: its component is null and it is kept only by near_duplicates' caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

WORDS, THRESHOLD = 5, 80
COORDINATES, TREES, LEVELS = 40, 8, 4
LEAF_ROWS, LEAF_SHINGLES = 4096, 2_000_000
#: Bytes of a leaf's bit rows at a time.
LEAF_BYTES = 32 << 20
#: Minhash agreement below the threshold by this share is not confirmed (over four standard deviations).
SLACK = 0.27
SIGNATURES = "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers = common.Powers()
_rng = np.random.default_rng(20250101)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and the offsets by text."""
    n, docs = len(data), len(offsets) - 1
    low = _LOWER[data]
    word = np.empty(n + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_WHITE[data], out=word[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:n]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    up, down = _powers.reach(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    w = common.mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)
    counts = np.diff(at)
    full = np.maximum(counts - words + 1, 0)
    made = np.where(full > 0, full, (counts > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(off[-1], np.uint64)
    long_docs = np.flatnonzero(full)
    if len(long_docs):
        m = max(0, len(w) - words + 1)
        s = np.zeros(m, np.uint64)
        for k in range(words):
            s += w[k : k + m] * _C[k]
        s = common.mix64(s)
        ok = np.zeros(m + 1, np.int32)  # a shingle may not cross the end of its text
        np.add.at(ok, at[:-1][long_docs], 1)
        np.add.at(ok, at[:-1][long_docs] + full[long_docs], -1)
        into = np.repeat(full > 0, made)
        out[into] = s[np.cumsum(ok[:m]) > 0]
    for d in np.flatnonzero((counts > 0) & (full == 0)):
        own = w[at[d] : at[d + 1]]
        out[off[d]] = common.mix64((own * _C[words : words + len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    for d in np.flatnonzero(made > 1):
        out[off[d] : off[d + 1]].sort()
    if not len(out):
        return out, off
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[off[:-1][made > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return out[new], total[off]


def _signatures(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for lo, hi in common.passes(offsets):
                h, off = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                some = np.flatnonzero(np.diff(off))
                sig = np.zeros((hi - lo, COORDINATES), np.uint32)
                keys = np.zeros((2, hi - lo), np.uint64)
                if len(some):
                    begin = off[some]
                    for k in range(COORDINATES):
                        v = h * _A[k]
                        v += _B[k]
                        v >>= np.uint64(32)
                        sig[some, k] = np.minimum.reduceat(v.astype(np.uint32), begin)
                    keys[0, some] = np.add.reduceat(h, begin)
                    keys[1, some] = np.add.reduceat(common.mix64(h), begin)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * COORDINATES, COORDINATES, dtype=np.int32)), pa.array(sig.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), rows], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return run


def _confirm(words: int, threshold: int):
    """Pairs come ordered by b; its set is made once for all pairs that follow one another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, b_set = None, None
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            a, b = (np.asarray(batch.column(k)) for k in (0, 1))
            other = batch.column(3)
            good = []
            for lo, hi in common.passes(offsets):
                h, off = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                for i in range(lo, hi):
                    if b[i] != held or b_set is None:
                        held = b[i]
                        b_set = shingle_sets(*common.utf8(other.slice(i, 1)), words)[0]
                    x = h[off[i - lo] : off[i - lo + 1]]
                    if 100 * min(len(x), len(b_set)) < threshold * max(len(x), len(b_set)):
                        continue
                    both = np.concatenate([x, b_set])
                    both.sort(kind="stable")
                    inter = int((both[1:] == both[:-1]).sum())
                    if 100 * inter >= threshold * (len(both) - inter):
                        good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def _by_node(solve):
    """Applies solve to the rows of each node; rows come ordered by node, the first column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            nodes = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and nodes[a] != now:
                    yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                now = nodes[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _similar(threshold: int):
    """Members of a node with one in another component whose size and signature don't rule a link out. Rows: node, rep, comp, n_shingles, sig."""
    least = int(COORDINATES * (threshold / 100 - SLACK))

    def solve(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = b.num_rows
        comp, size = np.asarray(b.column(2)), np.asarray(b.column(3))
        sig = np.asarray(b.column(4).flatten()).reshape(n, COORDINATES)
        some = np.zeros(n, bool)
        for lo in range(0, n, 128):
            agree = np.zeros((min(128, n - lo), n), np.uint8)
            for k in range(COORDINATES):
                agree += sig[lo : lo + 128, k, None] == sig[None, :, k]
            x = size[lo : lo + 128, None]
            near = (agree >= least) & (comp[lo : lo + 128, None] != comp) & (100 * np.minimum(x, size) >= threshold * np.maximum(x, size))
            some[lo : lo + 128] |= near.any(axis=1)
        if some.any():
            yield b.select(["node", "rep", "comp"]).filter(pa.array(some))

    return _by_node(solve)


def _intersections(row: np.ndarray, column: np.ndarray, n: int, columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row but the last, how many columns it shares with each later row. Bit rows cover LEAF_BYTES at a time; where that isn't all
    columns, counts are added up in a matrix of rows x rows, so neither grows with rows x columns."""
    wide = max(1, -(-columns // 64))
    step = min(wide, max(1, LEAF_BYTES // (8 * n)))
    total = np.zeros((n, n) if step < wide else (0, 0), np.int32)
    order = np.argsort(column, kind="stable") if step < wide else slice(None)
    row, column = row[order], column[order]
    for lo in range(0, wide, step):
        a, b = (np.searchsorted(column, [64 * lo, 64 * (lo + step)]) if step < wide else (0, len(column)))
        bits = np.zeros((n, min(step, wide - lo)), np.uint64)
        at = column[a:b] - 64 * lo
        np.bitwise_or.at(bits, (row[a:b], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        for i in range(n - 1):
            inter = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
            if step == wide:
                yield i, inter
            else:
                total[i, i + 1 :] += inter
    if step < wide:
        for i in range(n - 1):
            yield i, total[i, i + 1 :].astype(np.int64)


def _leaf(words: int, threshold: int):
    """Links between components of a node, on full sets: pairs (a, b) that connect whatever links connect. Rows: node, rep, comp, text."""
    from gatehouse.llm.vectors import merge

    def solve(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rep = np.asarray(b.column(1))
        n = len(rep)
        label = np.unique(np.asarray(b.column(2)), return_inverse=True)[1]
        first = np.full(label.max() + 1, n)
        np.minimum.at(first, label, np.arange(n))
        label = first[label]  # members of one component begin with one label
        data, offsets = common.utf8(b.column(3))
        sets = []
        for lo, hi in common.passes(offsets):
            h, off = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
            sets += [h[i:j] for i, j in zip(off, off[1:], strict=False)]
        size = np.array([len(x) for x in sets])
        tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(df > 1)
        number = np.full(len(tokens), -1)
        number[shared] = np.arange(len(shared))
        column, row = number[inverse], np.repeat(np.arange(n), size)
        row, column = row[column >= 0], column[column >= 0]
        start = label.copy()
        for i, inter in _intersections(row, column, n, len(shared)):
            j = np.flatnonzero(100 * inter >= threshold * (size[i] + size[i + 1 :] - inter)) + i + 1
            if len(j):
                label = merge(label, np.full(len(j), i), j)
        new = np.flatnonzero(label != start)
        if len(new):
            yield pa.RecordBatch.from_arrays([pa.array(rep[new]), pa.array(rep[label[new]])], names=["a", "b"])

    return _by_node(solve)


class _Join:
    """The classes of a corpus, their signatures and the texts that candidates need."""

    def __init__(self, docs: DataFrame, words: int, threshold: int):
        self.words, self.threshold = words, threshold
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.sigs = common.cut(base.mapInArrow(_signatures(words), SIGNATURES))
        sets = self.sigs.where("n_shingles > 0 and doc_id is not null")
        self.classes = common.cut(sets.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
        self.text = base.where("doc_id is not null")

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) whose sizes and signatures don't rule a link out."""
        side = self.classes.select("rep", "sig", "n_shingles")
        p = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct()
        p = p.join(side.toDF("a", "sa", "na"), "a").join(side.toDF("b", "sb", "nb"), "b")
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda t: t))
        return p.where((agree >= int(COORDINATES * (self.threshold / 100 - SLACK))) & (100 * F.least("na", "nb") >= self.threshold * F.greatest("na", "nb"))).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Candidates confirmed on full sets."""
        t = self.texts
        return common.cut(pairs.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(self.words, self.threshold), "a long, b long"))

    def leaf_links(self, members: DataFrame) -> DataFrame:
        """Links between components within nodes, from members (node, rep, comp)."""
        n = common.partitions(members.sparkSession)
        signed = members.join(self.classes.select("rep", "n_shingles", "sig"), "rep").select("node", "rep", "comp", "n_shingles", "sig")
        near = common.cut(signed.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_similar(self.threshold), "node long, rep long, comp long"))
        full = near.join(self.texts.toDF("rep", "text"), "rep").select("node", "rep", "comp", "text")
        return common.cut(full.repartition(n, "node").sortWithinPartitions("node", "rep").mapInArrow(_leaf(self.words, self.threshold), "a long, b long"))

    def nodes(self, members: DataFrame) -> DataFrame:
        """Members (node, rep) of nodes of two or more, with the node's size and first member."""
        # two aggregations would read members twice; a node's size and first member are combined before the shuffle
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lead"), F.sum("n_shingles").alias("total")).where("size > 1")
        return common.cut(members.drop("n_shingles").join(common.cut(sizes), "node"))


def _trees(classes: DataFrame) -> DataFrame:
    roots = F.array(*[F.xxhash64(F.lit(t), F.col("sig")[t * (COORDINATES // TREES)]) for t in range(TREES)])
    return classes.select("rep", "n_shingles", F.explode(roots).alias("node"))


def _branches(large: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """Two children of each node: each chooses a coordinate by the node's path."""
    rows = large.select("node", "rep").join(classes.select("rep", "n_shingles", "sig"), "rep")
    child = [F.xxhash64("node", F.lit(j), F.element_at("sig", (F.pmod(F.xxhash64("node", F.lit(level), F.lit(j)), F.lit(COORDINATES)) + 1).cast("int"))) for j in (0, 1)]
    return rows.select("rep", "n_shingles", F.explode(F.array(*child)).alias("node")).distinct()


def _in_nodes(multi: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of nodes that hold two components or more, with each member's component."""
    m = multi.join(comps.select(F.col("id").alias("rep"), "component_id"), "rep", "left").withColumn("comp", F.coalesce("component_id", "rep")).drop("component_id")
    open_ = common.cut(m.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node"))
    return m.join(open_, "node", "left_semi")


def _blocks(large: DataFrame) -> DataFrame:
    """Members of nodes that don't get smaller, dealt to blocks of half a leaf; every two blocks of a node are a leaf of their own."""
    k = F.ceil(F.greatest(F.col("size") * 2 / LEAF_ROWS, F.col("total") * 2 / LEAF_SHINGLES)).cast("long")
    rows = large.select("node", "rep", "comp", k.alias("k"), F.pmod(F.xxhash64("rep"), k).alias("own"))
    rows = rows.select("node", "rep", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "comp")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept for every row of docs."""
    join = _Join(docs, words, threshold)
    multi = join.nodes(_trees(join.classes))
    wanted = multi.select(F.col("rep").alias("doc_id")).distinct()
    join.texts = common.cut(join.text.join(wanted, "doc_id", "left_semi"))
    links = join.links(join.candidates(multi.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b"))))
    comps = common.components(links)
    leaves = []
    for level in range(LEVELS):
        held = common.cut(_in_nodes(multi, comps))
        fits = (F.col("size") <= LEAF_ROWS) & (F.col("total") <= LEAF_SHINGLES)
        leaves.append(held.where(fits).select("node", "rep", "comp"))
        large = held.where(~fits)
        if not large.limit(1).count():
            break
        if level == LEVELS - 1:
            leaves.append(_blocks(large))
        else:
            multi = join.nodes(_branches(large, join.classes, level))
    links = links.unionByName(join.leaf_links(reduce(DataFrame.unionByName, leaves)))
    comps = common.components(links)
    member = join.sigs.select("doc_id", "n_shingles", "h1", "h2").join(join.classes.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"], "left")
    out = member.join(comps.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), threshold=85)
