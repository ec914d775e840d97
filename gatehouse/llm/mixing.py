"""Mixing sources to target weights by Pfair scheduling, with DataFrame and SQL functions only.

A source's documents, in an order drawn by hash, form blocks of `BLOCK` documents. With integer weights q that sum to P,
block j of a source (from 0, within a phase) is released at slot floor(j P / q) and due at ceil((j + 1) P / q); each slot
takes the released block with the earliest deadline. Unit blocks on one line of slots with these windows are always
feasible, so in every prefix each source is less than one block away from its target share. The schedule of a phase
repeats every P slots, when all sources are exactly on target, so one period is scheduled and its positions are computed for
any number of blocks. A phase ends with a source's last block; then the others start anew with their weights among
themselves. Every document is kept and gets a place.

Weights: given by source, else in proportion to the source's documents to the power `ALPHA`. A source that isn't named in
given weights gets the smallest of them. Weights are rounded to about 1/`PERIOD`, at least 1/`PERIOD`. The schedule costs
sources x PERIOD for each phase and is made once, in one row; it is meant for up to some hundred sources.

The bound holds within each phase: in every prefix of a phase each source is less than one block from its share among the sources
that are left. Once a source has ended, the shares over the whole prefix are no longer those of the target weights.

A null source is a source of its own. Repeated rows each get a place; ties in the hash order are broken by doc_id. Empty
tables give no rows. mix() reads ids and sources only, so very long texts cost nothing; rows without doc_id share one hash bucket there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatehouse.llm import common

BLOCK, PERIOD, ALPHA = 64, 1024, 0.5
#: Rows of one source and rank bucket, and the most buckets: rows are ranked within buckets, buckets by running counts.
BUCKET_ROWS, MAX_BUCKETS = 512, 1 << 16
#: Blocks that one row of the plan is dealt out by.
PART = 16384

#: One period by earliest deadline first. b.q: weights, 0 if inactive; b.P: their sum. Gives the source of each slot.
_PERIOD_SQL = """
aggregate(sequence(0L, b.P - 1L), struct(transform(b.q, x -> 0L) AS done, CAST(array() AS array<bigint>) AS line),
  (s, t) -> transform(array(array_min(transform(b.q, (x, i) ->
      if(x > 0 AND (s.done[i] * b.P) div x <= t, struct(((s.done[i] + 1L) * b.P + x - 1L) div x AS due, CAST(i AS bigint) AS i), NULL)))),
    c -> struct(transform(s.done, (x, i) -> if(i = c.i, x + 1L, x)) AS done, concat(s.line, array(c.i)) AS line))[0],
  s -> s.line)
"""

#: A phase: what is left by source -> the places of each source in a period, and the blocks until the first source ends.
_PHASES_SQL = f"""
aggregate(sequence(1, size(w)), struct(blocks AS rest, transform(w, x -> 0L) AS used, 0L AS t,
    CAST(array() AS array<struct<t: bigint, P: bigint, q: array<bigint>, used: array<bigint>, taken: array<bigint>, places: array<array<bigint>>>>) AS phases),
  (state, k) -> if(forall(state.rest, x -> x = 0), state,
    transform(array(struct(transform(w, (x, i) -> if(state.rest[i] > 0, x, 0L)) AS q)), a ->
    transform(array(struct(a.q AS q, aggregate(a.q, 0L, (s, x) -> s + x) AS P)), b ->
    transform(array(struct(b.q AS q, b.P AS P, {_PERIOD_SQL} AS line)), c ->
    transform(array(struct(c.q AS q, c.P AS P, transform(c.q, (x, i) -> filter(sequence(0L, c.P - 1L), o -> c.line[CAST(o AS int)] = i)) AS places)), d ->
    transform(array(struct(d.q AS q, d.P AS P, d.places AS places, 1L + array_min(transform(d.q, (x, i) ->
        if(x > 0, ((state.rest[i] - 1L) div x) * d.P + d.places[i][CAST((state.rest[i] - 1L) % x AS int)], NULL))) AS slots)), e ->
    transform(array(struct(e.q AS q, e.P AS P, e.places AS places, e.slots AS slots, transform(e.q, (x, i) ->
        (e.slots div e.P) * x + CAST(size(filter(e.places[i], o -> o < e.slots % e.P)) AS bigint)) AS taken)), f ->
      struct(transform(state.rest, (x, i) -> x - f.taken[i]) AS rest, transform(state.used, (x, i) -> x + f.taken[i]) AS used, state.t + f.slots AS t,
        concat(state.phases, array(struct(state.t AS t, f.P AS P, f.q AS q, state.used AS used, f.taken AS taken, f.places AS places))) AS phases)
    )[0])[0])[0])[0])[0])[0]),
  state -> state.phases)
"""


def _key(source):
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _ranked(docs: DataFrame, *ids: str) -> tuple[DataFrame, DataFrame]:
    """The id columns, source, key and the document's number `idx` in its source's order; and the documents of each key. ids: doc_id, and a hash that orders rows without one."""
    n = docs.select("source").count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    own = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")  # 60 bits
    other = F.shiftrightunsigned(F.col(ids[1]), 4) if len(ids) > 1 else F.lit(0).cast("long")
    base = docs.select(*ids, "source").withColumns({"key": _key(F.col("source")), "h": F.coalesce(own, other)})
    base = base.withColumn("bucket", F.shiftright(F.shiftright("h", 30) * F.lit(buckets), 30))  # in the order of h
    counts = common.cut(base.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n")))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("key").orderBy("bucket")) - F.col("n")).drop("n")
    numbered = base.withColumn("rn", F.row_number().over(W.partitionBy("key", "bucket").orderBy("h", *ids)) - 1)
    ranked = numbered.join(before, ["key", "bucket"]).withColumn("idx", F.col("before") + F.col("rn"))
    return ranked.select(*ids, "source", "key", "idx"), counts.groupBy("key").agg(F.sum("n").alias("n"))


def schedule(sizes: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA) -> DataFrame:
    """A row for each block: key, block, slot, release, deadline, and lead, the place of its first document. sizes: key, n."""
    if weights:
        entries = [x for k, v in weights.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*entries)[F.col("key")], F.lit(min(map(float, weights.values()))))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(alpha))
    one = sizes.select("key", "n", weight.alias("v")).agg(F.sort_array(F.collect_list(F.struct("key", "n", "v"))).alias("s")).where("size(s) > 0")
    one = one.withColumn("total", F.expr("aggregate(s, 0D, (a, x) -> a + x.v)"))
    one = one.select("s", F.expr(f"transform(s, x -> greatest(1L, CAST(round(x.v / total * {period}) AS bigint)))").alias("w"), F.expr(f"transform(s, x -> (x.n + {block - 1}L) div {block}L)").alias("blocks"))
    phases = common.cut(one.select("s", F.expr(_PHASES_SQL).alias("phases")))
    # short blocks: the last of a source may lack documents, and every later place moves up by that
    phases = phases.withColumn("lacks", F.expr(f"""filter(transform(s, (x, i) -> transform(filter(phases, p -> p.taken[i] > 0 AND p.used[i] + p.taken[i] = (x.n + {block - 1}L) div {block}L), p ->
        struct(p.t + ((p.taken[i] - 1) div p.q[i]) * p.P + p.places[i][CAST((p.taken[i] - 1) % p.q[i] AS int)] AS at, (p.used[i] + p.taken[i]) * {block}L - x.n AS n))[0]), x -> x.n > 0)"""))
    runs = phases.select("s", "lacks", F.explode("phases").alias("p")).select("s", "lacks", "p", F.posexplode("p.q").alias("i", "q")).where("p.taken[i] > 0")
    runs = runs.select(F.expr("s[i].key").alias("key"), "lacks", F.expr("p.t").alias("t"), F.expr("p.P").alias("p"), "q", F.expr("p.used[i]").alias("first"), F.expr("p.taken[i]").alias("taken"), F.expr("p.places[i]").alias("places"))
    # long runs are dealt out in parts before they become blocks
    parts = runs.select("*", F.explode(F.expr(f"sequence(0L, taken - 1, {PART}L)")).alias("start")).repartition(common.partitions(sizes.sparkSession), "key", "start")
    made = parts.select("key", "lacks", "t", "p", "q", "first", "places", F.explode(F.expr(f"sequence(start, least(start + {PART}L, taken) - 1)")).alias("j"))
    slot = F.expr("t + (j div q) * p + places[CAST(j % q AS int)]")
    made = made.select("key", "lacks", (F.col("first") + F.col("j")).alias("block"), slot.alias("slot"), F.expr("t + (j * p) div q").alias("release"), F.expr("t + ((j + 1) * p + q - 1) div q").alias("deadline"))
    return made.select("key", "block", "slot", "release", "deadline", F.expr(f"slot * {block}L - aggregate(filter(lacks, x -> x.at < slot), 0L, (a, x) -> a + x.n)").alias("lead"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns, source, block (of its source), slot, release, deadline and position, from 0 without gaps, of every row."""
    ranked, sizes = _ranked(docs, *ids)
    plan = schedule(sizes, weights, block, period, alpha)
    rows = ranked.withColumn("block", F.floor(F.col("idx") / block)).join(plan, ["key", "block"])
    return rows.select(*ids, "source", "block", "slot", "release", "deadline", (F.col("lead") + F.col("idx") % block).alias("position"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, in partitions and files that follow the mixed order; columns of any name pass through.

    Places are made for two 64-bit hashes of the whole row, so rows without an id are spread like others, and joined to the rows once. Rows that
    are equal in every column are joined as one, which gets all their places.
    """
    row, more, part = (common.free_name(docs, x) for x in ("row", "more", "place"))
    whole, key = [F.to_json(F.struct(c)) if "map" in t or "variant" in t else F.col(c) for c, t in docs.dtypes], [row, more]
    keyed = docs.withColumns({row: F.xxhash64(*whole), more: F.xxhash64(F.lit(1), *whole)})
    places = common.cut(mix(keyed.select("doc_id", "source", *key), ids=("doc_id", *key), **options).select(*key, F.col("position").alias(part)))
    again = common.cut(places.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key))
    if again.limit(1).count():
        keyed = keyed.join(again, key, "left_anti").unionByName(keyed.join(again, key, "left_semi").dropDuplicates(key))
    placed = keyed.join(places, key)
    return placed.repartitionByRange(common.partitions(docs.sparkSession), part).sortWithinPartitions(part).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
