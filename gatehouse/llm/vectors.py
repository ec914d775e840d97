"""Embedding near-duplicates by an exact metric range join.

Vectors of one label are unit vectors, so cosine >= c is Euclidean distance <= r = sqrt(2 - 2c). Labels of more than a
block of rows are parted into cells: pivots, a bounded sample of the vectors themselves, take the vectors they are nearest
to. Two vectors x and y of different cells can be within r only if both lie within r of the plane halfway between the two
pivots; for two cells only such rows are compared. This bound implies the one of the triangle inequality, |d(x, p) - d(x, q)| <= 2r.

No vector is replicated. Each goes through one shuffle: whole labels where they are small, else blocks of cells in
order, a large cell (a dense cluster that no pivot can part) dealt to several by hash. Blocks are written once to the
checkpoint folder, and every two blocks of a label are a task that reads both from there (`_pairs`). So disk grows with
the input whatever the vectors, and only what is compared grows with the number of blocks.

Equal vectors are collapsed, within each batch before the shuffle and then in their block, and count with their weight.
They are known by 128 bits of hash. Single precision decides only what it can't get wrong: cosines about the limit
are computed again in double precision.

Pivots only decide the cost: any set of pivots gives every link. `PIVOTS` bounds how many are drawn (by a hash of the vector),
about one for `CELL` vectors; a label without a pivot is one cell. Labels null, vectors null, zero, empty or with null or
non-finite components link with nothing; they are their own component and kept. Vectors of unequal lengths aren't
compared. Repeated rows are equal vectors; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

COSINE, CELL, PIVOTS = 0.98, 1024, 4096
#: Vectors of a block, and bytes of vectors; entries of a matrix of cosines that are held at once.
BLOCK, BLOCK_BYTES, ENTRIES = 65_536, 1 << 25, 1 << 21
#: Added to the bounds, far above rounding in single precision, so that no pair at the limit is missed.
ROUNDING = 1e-4
ROWS = "part long, key string, cell int, h1 long, h2 long, rep long, weight long, v binary"
FOUND = "h1 long, h2 long, rep long, n_links long, root long"


def _batch(schema: str, cols: Iterable) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(cols, kinds, strict=True)], names=names)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _merge_equal(h1: np.ndarray, h2: np.ndarray, rep: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group of equal vectors one row's index, the smallest id and the sum of weights."""
    order = np.lexsort((rep, h2, h1))
    new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
    return order[new], rep[order][new], np.add.reduceat(weight[order], np.flatnonzero(new))


def _assign(pivots: dict[str, np.ndarray], deal: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
    """Every vector with its cell and, by deal (first part and number of parts of a label's cells), its part. Equal vectors of a batch are one row.

    Rows: key, h1, h2, vec_id, embedding."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                h1, h2, ids = (b.column(k).to_numpy() for k in (1, 2, 3))
                take, rep, weight = _merge_equal(h1, h2, ids, np.ones(len(ids), np.int64))
                b = b.take(pa.array(take))
                h1, h2, keys = h1[take], h2[take], np.array(b.column(0).to_pylist(), object)
                flat, ends = b.column(4).flatten().to_numpy(zero_copy_only=False), np.cumsum(b.column(4).value_lengths().to_numpy(zero_copy_only=False)).tolist()
                vectors = [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                cell, part = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64)
                for key in set(keys.tolist()) if pivots or deal else ():
                    at = np.flatnonzero(keys == key)
                    if key in pivots:
                        cell[at] = (_unit(np.stack([vectors[i] for i in at])) @ pivots[key].T).argmax(axis=1)
                    if deal is not None:
                        first, parts = deal[key]
                        part[at] = first[cell[at]] + h1[at] % parts[cell[at]]
                yield _batch(ROWS, (part, keys, cell, h1, h2, rep, weight, [x.tobytes() for x in vectors]))

    return run


class Block:
    """Different vectors of one label, by cell and id. Single-precision copies are made where a task compares it."""

    def __init__(self, rows: list[tuple], dims: int):
        """rows: cell, h1, h2, rep, weight, vector."""
        cell, h1, h2, rep, weight = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        take, rep, self.weight = _merge_equal(h1, h2, rep, weight)
        order = np.lexsort((rep, cell[take]))
        take, self.rep, self.weight = take[order], rep[order], self.weight[order]
        self.cell, self.h1, self.h2 = cell[take], h1[take], h2[take]
        self.raw = np.frombuffer(b"".join(rows[i][5] for i in take), np.float32 if len(rows[0][5]) == 4 * dims else np.float64).reshape(-1, dims)

    def cells(self) -> list[tuple[int, slice]]:
        start = np.flatnonzero(np.concatenate([[True], self.cell[1:] != self.cell[:-1]])).tolist()
        return [(int(self.cell[a]), slice(a, b)) for a, b in zip(start, [*start[1:], len(self.cell)], strict=True)]

    def single(self) -> np.ndarray:
        x = np.empty(self.raw.shape, np.float32)
        for lo in range(0, len(x), 4096):
            x[lo : lo + 4096] = _unit(self.raw[lo : lo + 4096])
        return x


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j: the smallest index of each component."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(label, np.concatenate([a, b]), np.concatenate([low, low]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _linked(cos: np.ndarray, a: Block, i: np.ndarray, b: Block, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs i x j the rows and columns with links, and which are links; what single precision can't tell is computed in double precision."""
    margin = 1e-6 + 4e-7 * a.raw.shape[1]  # above the sum of all roundings of a product of unit vectors
    linked = cos >= np.float32(cosine - margin)
    p = np.flatnonzero(linked.any(axis=1))
    q = np.flatnonzero(linked[p].any(axis=0))
    i, j, linked = i[p], j[q], linked[np.ix_(p, q)]
    p, q = np.nonzero(linked & (cos[np.ix_(p, q)] < np.float32(cosine + margin)))
    for lo in range(0, len(p), 4096):
        u, v = p[lo : lo + 4096], q[lo : lo + 4096]
        linked[u, v] = (_unit(a.raw[i[u]]) * _unit(b.raw[j[v]])).sum(axis=1) >= cosine
    return i, j, linked


def _join(a: Block, b: Block, pivots: np.ndarray | None, cosine: float) -> pa.RecordBatch:
    """Links between two blocks of a label, or within one: weight of what each vector is linked with, and a root among the links seen here."""
    same = a is b
    x, n = a.single(), len(a.rep)
    y = x if same else b.single()
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.rep), np.int64)
    label = np.arange(n if same else n + len(b.rep))
    reach = 2 * (np.sqrt(max(0.0, 2 - 2 * cosine)) + ROUNDING)
    if pivots is not None:
        p = pivots.astype(np.float32)
    cells_a, cells_b = a.cells(), b.cells()
    if pivots is not None:  # how far a vector is from being nearer to another cell's pivot than to its own
        away_a, away_b = ([2 * ((z[s] @ p[c])[:, None] - z[s] @ p[[d for d, _ in others]].T) for c, s in own] for z, own, others in ((x, cells_a, cells_b), (y, cells_b, cells_a)))
    for m, (c, s) in enumerate(cells_a):
        for k, (d, t) in enumerate(cells_b):
            if same and d < c:
                continue
            i, j = np.arange(s.start, s.stop), np.arange(t.start, t.stop)
            if c != d:
                gap = reach * np.linalg.norm(pivots[c] - pivots[d]) + ROUNDING
                i, j = i[away_a[m][:, k] <= gap], j[away_b[k][:, m] <= gap]
            if not len(i) or not len(j):
                continue
            right, step = y[j], max(1, ENTRIES // len(j))
            for lo in range(0, len(i), step):
                u = i[lo : lo + step]
                if same and c == d:
                    j, right = j[j > u[0]], right[j > u[0]]
                u, v, linked = _linked(x[u] @ right.T, a, u, b, j, cosine)
                if same and c == d:
                    linked &= u[:, None] < v
                links_a[u] += (linked @ b.weight[v].astype(np.float64)).astype(np.int64)
                links_b[v] += (a.weight[u].astype(np.float64) @ linked).astype(np.int64)
                to = v if same else v + n
                e, f = np.nonzero(linked & (label[u][:, None] != label[to]))
                label = merge(label, u[e], to[f])
    if same:
        links, blocks = links_a + links_b, (a,)
    else:
        links, blocks = np.concatenate([links_a, links_b]), (a, b)
    h1, h2, rep = (np.concatenate([getattr(o, name) for o in blocks]) for name in ("h1", "h2", "rep"))
    tell = links > 0
    return _batch(FOUND, (h1[tell], h2[tell], rep[tell], links[tell], rep[label[tell]]))


def _alone(block: Block) -> pa.RecordBatch:
    """Links among equal vectors."""
    tell = block.weight > 1
    return _batch(FOUND, (block.h1[tell], block.h2[tell], block.rep[tell], block.weight[tell] - 1, block.rep[tell]))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    """Rows come by part and key; those of a part and key are a block."""
    now, rows = None, []
    for b in batches:
        for part, key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (part, key) != now and rows:
                yield now[1], Block(rows, _dims(now[1]))
                rows = []
            now = part, key
            rows.append(tuple(row))
    if rows:
        yield now[1], Block(rows, _dims(now[1]))


def _dims(key: str) -> int:
    return int(key.rpartition("#")[2])


def _join_labels(cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            yield _alone(block)
            yield _join(block, block, None, cosine)

    return run


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, block in _blocks(batches):
        yield _batch("key string, block binary", ([key], [pickle.dumps(block, protocol=5)]))


def _join_packed(pivots: dict[str, np.ndarray], cosine: float):
    def run(pairs: Iterable[tuple]) -> Iterator[tuple]:
        for one, two in pairs:
            a = pickle.loads(one["block"])
            same = one["block"] == two["block"]
            for found in [_alone(a), _join(a, a, pivots.get(one["key"]), cosine)] if same else [_join(a, pickle.loads(two["block"]), pivots.get(one["key"]), cosine)]:
                yield from zip(*(c.to_pylist() for c in found.columns), strict=True)

    return run


def _only(rdd, partitions: Iterable[int], sc):
    """The JVM's rdd with these partitions alone."""
    jvm = sc._jvm
    return jvm.org.apache.spark.rdd.PartitionPruningRDD.create(rdd, jvm.org.apache.spark.api.python.PythonUtils.toSeq([int(i) for i in partitions]).toSet())


def _pairs(blocks: DataFrame, labels: list[tuple[int, int]]) -> RDD:
    """Every two blocks of a label, and each with itself: a partition each, which reads both from the checkpoint. labels: ranges of partitions."""
    sc, rdd = blocks.sparkSession.sparkContext, blocks.rdd
    both = rdd.cartesian(rdd)._jrdd_deserializer
    each = []
    for lo, hi in labels:
        n = hi - lo
        own = _only(rdd._jrdd.rdd(), range(lo, hi), sc).toJavaRDD()
        wanted = _only(own.cartesian(own).rdd(), (i * n + j for i in range(n) for j in range(i, n)), sc)
        each.append(RDD(wanted.toJavaRDD(), sc, both))
    return sc.union(each)


def _large(rows: DataFrame, keys: dict[str, int], cosine: float, block: int) -> DataFrame:
    """FOUND of the labels in keys, which are of more than a block of rows."""
    spark = rows.sparkSession
    n = sum(keys.values())
    k = min(PIVOTS, n // CELL)
    drawn = rows.where(F.abs(F.col("h1").cast("double")) <= 2.0**63 * min(1.0, 4 * k / n)).dropDuplicates(["key", "h1", "h2"]).orderBy("h1", "h2", "key").limit(k).select("key", "embedding").collect()  # at most PIVOTS rows
    found: dict[str, list] = {}
    for r in drawn:
        found.setdefault(r["key"], []).append(_unit(np.array([r["embedding"]]))[0])
    pivots = {key: np.stack(v) for key, v in found.items()}
    counts = rows.mapInArrow(_assign(pivots), ROWS).groupBy("key", "cell").count().collect()  # at most a row for a pivot, and one for a label
    sizes = {key: np.ones(len(pivots.get(key, [0])), np.int64) for key in keys}
    for r in counts:
        sizes[r["key"]][r["cell"]] = r["count"]  # above what is left once copies of other batches are merged
    deal, labels, at = {}, [], 0
    for key, size in sizes.items():
        most = max(1, min(block, BLOCK_BYTES // (8 * _dims(key))))
        parts = np.maximum(1, -(-size // most))
        first, lo, held = np.zeros(len(size), np.int64), at, 0
        for c, (rows_of, m) in enumerate(zip(size.tolist(), parts.tolist(), strict=True)):
            if held and held + rows_of > most:
                at, held = at + 1, 0
            first[c] = at
            held += rows_of
            if m > 1:
                at, held = at + m, 0
        at += bool(held)
        deal[key] = first, parts
        labels.append((lo, at))
    dealt = rows.mapInArrow(_assign(pivots, deal), ROWS).repartitionById(at, F.col("part").cast("int")).sortWithinPartitions("part", "key", "cell")
    blocks = common.cut(dealt.mapInArrow(_pack, "key string, block binary"))
    return spark.createDataFrame(_pairs(blocks, labels).mapPartitions(_join_packed(pivots, cosine)), FOUND, verifySchema=False)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    embedding = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), embedding.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    base = base.withColumn("key", F.when(ok, F.concat_ws("#", "label", F.size("embedding").cast("string"))))
    base = base.select("vec_id", "embedding", "key", *(F.when(F.col("key").isNotNull(), F.xxhash64(F.lit(seed), "key", "embedding")).otherwise(F.xxhash64(F.lit(-seed), "vec_id")).alias(name) for seed, name in ((1, "h1"), (2, "h2"))))
    rows = base.where("key is not null").select("key", "h1", "h2", "vec_id", "embedding")
    most = F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.substring_index("key", "#", -1).cast("long"))))
    keys = {r["key"]: r["count"] for r in rows.groupBy("key").count().where(F.col("count") > most).orderBy("key").collect()}  # labels of more than a block
    small = rows.where(~F.col("key").isin([*keys])) if keys else rows
    few = small.mapInArrow(_assign({}), ROWS).repartition(common.partitions(spark), "key").sortWithinPartitions("part", "key", "rep")
    found = few.mapInArrow(_join_labels(cosine), FOUND)
    if keys:
        found = found.unionByName(_large(rows.where(F.col("key").isin([*keys])), keys, cosine, block))
    found = common.cut(found)
    comps = common.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("h1", "h2").agg(F.min("rep").alias("rep"), F.sum("n_links").alias("n_links"))
    told = common.cut(links.join(comps.select(F.col("id").alias("rep"), "component_id"), "rep", "left"))
    out = base.select("vec_id", "h1", "h2").join(told, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "rep", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
