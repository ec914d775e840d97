"""Shared pieces of the llm operators: UTF-8 buffers, hashes, checkpoints and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut, ensure_checkpoint_dir, partitions
from gatehouse.sources.adapters import spread

#: Bytes of text that one vectorised numpy pass covers; a longer document is a pass of its own.
PASS_BYTES = 1 << 20

#: Keys with more than one row in so many are hot; there can't be more than so many of them.
HOT = 10_000

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table over all cores, where its files give fewer partitions."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a polynomial hash is usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array without copying, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, made as far as needed."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, PASS_BYTES + 64)
            steps = np.full(m, self.base, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = np.uint64(self.inverse)
            self.down = np.cumprod(steps)
        return self.up[:n], self.down[:n]


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Smallest id reachable from each end of `edges` (two long columns): rows (id, component_id).

    Labels move along edges to the neighbours and to the neighbours' labels, then every label is replaced by
    its own label, so rounds grow with the logarithm of a path's length. All aggregations are min, which are
    combined before the shuffle, so a vertex with many edges is no hot task. Each round is checkpointed.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = e.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("l")), F.struct(F.col("b").alias("id"), F.col("a").alias("l")))).alias("x")).groupBy("x.id").agg(F.min("x.l").alias("l"))
    labels = cut(labels)
    while True:  # labels only get smaller, so it ends
        la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
        both = e.join(la, "a").join(lb, "b").where("la <> lb")
        low, high = F.least("la", "lb"), F.greatest("la", "lb")
        offers = both.select(F.explode(F.array(F.struct(F.col("a").alias("id"), low.alias("l")), F.struct(F.col("b").alias("id"), low.alias("l")), F.struct(high.alias("id"), low.alias("l")))).alias("x")).select("x.id", "x.l")
        best = labels.unionByName(offers).groupBy("id").agg(F.min("l").alias("l"))
        up = best.select(F.col("id").alias("l"), F.col("l").alias("ll"))
        new = cut(best.join(up, "l", "left").select("id", F.coalesce("ll", "l").alias("l")))
        moved = new.join(labels.select("id", F.col("l").alias("old")), "id").where("l <> old").limit(1).count()
        labels = new
        if not moved:
            return labels.select("id", F.col("l").alias("component_id"))


def written(df: DataFrame, stem: str) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, which holds columns of many repeated numbers in far fewer bytes than a checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{stem}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to `table`, in which `key` is unique and `count` tells how many of rows hold it.

    A key held by more than one row in HOT goes by broadcast, and there are at most HOT of these; all others are shuffled, so no task
    holds a key of more rows than that. table should be a checkpoint, since it is read several times.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.broadcast(table.where(F.col(count) * HOT > total))
    rest = rows.join(F.broadcast(table.where(F.col(count) * HOT > total).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col(count) * HOT <= total), key))


def dropped_names(df: DataFrame, *reserved: str) -> DataFrame:
    """df without columns whose names an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in reserved])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df has not, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


__all__ = ["PASS_BYTES", "Powers", "components", "cut", "dropped_names", "ensure_checkpoint_dir", "free_name", "join_counted", "mix64", "partitions", "passes", "table", "utf8", "written"]
