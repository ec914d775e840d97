"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens, improved by local search.

Every document is tokenised (its ids, then the end id); one that is longer than a sequence is cut into full pieces, of
which only the first may be shorter. Full pieces are sequences of their own. Shorter ones are packed within groups of
some thousand pieces: best-fit in decreasing order, then swap-based local search between underfull bins — move one
item, or exchange one or two for one or two — where each step raises the sum of squared fills, until bins empty
or the group's lower bound is met. What crosses the network is a short row for each piece, never text or ids.

Groups are dealt by hash. The emptiest bins of every group, up to `OFFERED`, are packed once more with those of other groups, `JOINED`
groups at a time, until one group is left, so that what remains underfull doesn't grow with the number of groups. Where the order of the
documents matters, as after mixing, pack_in_order makes groups of contiguous ranges of the order instead, and numbers sequences along it.

Nulls count as empty texts (the end id alone), very long texts are tokenised whole, repeated rows are packed each, an empty table gives
no rows, and extra columns are ignored. Within a group items are sorted by all their fields before packing, so ties are settled and a
recomputed task gives the same sequences. A control string of the tokenizer within a text is that token, as the library has it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common
from gatehouse.llm.bytebpe import byte_bpe

CAPACITY, END_ID = 1024, 2
#: Documents of a group where their order counts, and where it does not.
GROUP_DOCS, DEALT_DOCS = 4096, 16384
#: Bins that a group offers to other groups, and the groups that are packed together then.
OFFERED, JOINED = 64, 16
#: Bytes of text that are tokenised at once.
PASS_BYTES = 2_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_path() -> str:
    """The public 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenise(path: str, capacity: int, end_id: int):
    """Pieces of (doc_id, text); a third column, a document's place, is handed on with each piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            offsets = common.utf8(batch.column(1))[1]
            for lo, hi in common.passes(offsets, PASS_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1).fill_null("").to_pylist()
                ids, at = bpe.ids(texts)
                rows = []
                places = [(x,) for x in part.column(2).to_pylist()] if part.num_columns > 2 else [()] * (hi - lo)
                for doc_id, a, b, place in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), places, strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    rows += [(doc_id, k, x, y - x, zlib.crc32(own[x:y]), *place) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield _batch(rows, TYPES[:5] + ([PLACE] if part.num_columns > 2 else []))

    return run


TYPES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PLACE, OPEN = ("place", pa.int64()), ("open", pa.bool_())


def _batch(rows: list[tuple], types: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[x for x, _ in types])


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indexes: each item, longest first, goes to the bin it fills best. Free sizes are bits of an integer."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class Search:
    """Swap-based local search between underfull bins. The least filled bin gives one or two items to a fuller bin and takes none, one or two
    back, as the fuller bin is filled most by; each step raises the sum of squared fills. A bin from which no step leads waits until another
    step is made. It ends at the lower bound or where no bin has a step."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.size, self.capacity = np.array(lengths, np.int64), capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.bin_of = np.zeros(len(lengths), np.int64)
        for k, own in enumerate(self.bins):
            self.bin_of[own] = k
        self.live, self.least = sum(map(bool, self.bins)), -(-sum(lengths) // capacity)

    def run(self) -> list[list[int]]:
        waits = np.zeros(len(self.bins), bool)
        while self.live > self.least:
            able = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & ~waits)
            if not len(able):
                break
            s = int(able[self.fill[able].argmin()])
            moved = False
            while self.bins[s] and self._step(s):
                moved = True
            if moved:
                waits[:] = False
            waits[s] = True
        return [b for b in self.bins if b]

    def _step(self, s: int) -> bool:
        size, own = self.size, self.bins[s]
        room = np.where((self.fill < self.capacity) & (self.fill >= self.fill[s]), self.capacity - self.fill, 0)
        room[s] = 0
        most = int(room.max())
        if not most:
            return False
        single = np.flatnonzero(room[self.bin_of] > 0)
        pairs = [(i, j) for t in np.flatnonzero(room).tolist() for i, j in combinations(self.bins[t], 2)]
        first = np.array([*single.tolist(), *(i for i, _ in pairs)], np.int64)
        second = np.array([*[-1] * len(single), *(j for _, j in pairs)], np.int64)
        taken, fits = size[first] + np.where(second < 0, 0, size[second]), room[self.bin_of[first]]
        gain, give, take, to = 0, (), (), -1
        for items in [*((i,) for i in own), *combinations(own, 2)]:
            n = int(size[list(items)].sum())
            if len(items) == 1 and gain < n <= most:  # a move, to the bin that it fills best
                able = np.flatnonzero(room >= n)
                gain, give, take, to = n, items, (), int(able[room[able].argmin()])
            if n > gain and len(first):
                more = n - taken
                more[(more < 0) | (more > fits)] = 0
                k = int(more.argmax())
                if more[k] > gain:
                    gain, give, to = int(more[k]), items, int(self.bin_of[first[k]])
                    take = tuple(int(x) for x in (first[k], second[k]) if x >= 0)
            if gain == most:
                break
        if not gain:
            return False
        for items, at in ((take, s), (give, to)):
            for i in items:
                self.bins[self.bin_of[i]].remove(i)
                self.bins[at].append(i)
                self.bin_of[i] = at
        self.fill[s] -= gain
        self.fill[to] += gain
        self.live -= not self.bins[s]
        return True


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """The bins after Search: never more than before."""
    return Search(bins, lengths, capacity).run() if bins else []


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_group(capacity: int, level: int = 0):
    """Packs the rows of a task; the emptiest bins are marked open. Rows that come with a sequence_id are never packed into more sequences than they have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = (level << 58) + (TaskContext.get().partitionId() << 33)
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0] is not None, r))
        short = [r for r in rows if r[3] < capacity]
        lengths = [r[3] for r in short]
        bins = pack(lengths, capacity)
        if level:
            had: dict[int, list[int]] = {}
            for i, r in enumerate(short):
                had.setdefault(r[5], []).append(i)
            if len(bins) > len(had):
                bins = local_search([list(b) for b in had.values()], lengths, capacity)
        fill = [sum(lengths[i] for i in b) for b in bins]
        offered = set(sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: (fill[k], k))[:OFFERED])
        number, out = 0, []
        for b in bins:
            at = 0
            for i in b:
                out.append((*short[i][:5], group + number, at, number in offered))
                at += lengths[i]
            number += 1
        for r in rows:
            if r[3] >= capacity:
                out.append((*r[:5], group + number, 0, False))
                number += 1
        for lo in range(0, len(out), 8192):
            yield _batch(out[lo : lo + 8192], [*TYPES, OPEN])

    return run


def _pack_ranges(capacity: int, group_docs: int):
    """Packs each range of group_docs places; its sequences, and the pieces within them, follow the mean place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[5], r[1]))
        for group, own in groupby(rows, key=lambda r: r[5] // group_docs):
            own = list(own)
            short = [r for r in own if r[3] < capacity]
            bins = [[short[i] for i in sorted(b)] for b in pack([r[3] for r in short], capacity)] + [[r] for r in own if r[3] >= capacity]
            bins.sort(key=lambda b: (sum(r[5] for r in b) / len(b), b[0][5], b[0][1]))
            out = []
            for k, b in enumerate(bins):
                at = 0
                for r in b:
                    out.append((*r[:5], (group << 33) + k, at))
                    at += r[3]
            for lo in range(0, len(out), 8192):
                yield _batch(out[lo : lo + 8192], TYPES)

    return run


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(path, capacity, end_id), PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = DEALT_DOCS) -> DataFrame:
    """A row for each piece with its place in a sequence. Groups hold about `group_docs` documents, of any input size."""
    pieces = tokenised_pieces(docs, path or tokenizer_path(), capacity, end_id)
    groups = max(1, -(-docs.select("doc_id").count() // group_docs))
    packed = pieces.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(_pack_group(capacity), f"{PACKED}, open boolean")
    done, level = [], 0
    while groups > 1:
        packed, level = common.cut(packed), level + 1
        done.append(packed.where("not open").drop("open"))
        groups = -(-groups // JOINED)
        offered = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id")
        packed = offered.repartition(groups, F.shiftright("sequence_id", 33)).mapInArrow(_pack_group(capacity, level), f"{PACKED}, open boolean")
    return reduce(DataFrame.unionByName, [*done, packed.drop("open")])


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text and place, the row's number in the order of docs: of its Parquet files by name if docs is read from them, else of its partitions. And the number of rows."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    try:
        if not docs._jdf.queryExecution().analyzed().children().isEmpty():
            raise AnalysisException("not read as it is from files")
        rows = docs.select(*columns, F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        number = F.monotonically_increasing_id()
        rows = docs.select(*columns, F.shiftright(number, 33).cast("string").alias("part"), number.bitwiseAND((1 << 33) - 1).alias("row"))
    counts = dict(rows.groupBy("part").agg(F.count(F.lit(1))).collect())
    starts, n = [], 0
    for part in sorted(counts, key=lambda p: re.sub(r"\d+", lambda m: m[0].zfill(20), p.rsplit("/", 1)[-1])):
        starts.append((part, n))
        n += counts[part]
    first = docs.sparkSession.createDataFrame(starts, "part string, first long")
    return rows.join(F.broadcast(first), "part").select("doc_id", "text", (F.col("first") + F.col("row")).alias("place")), n


def pack_in_order(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """As pack_documents, but a group is the next `group_docs` documents in the order of docs, and sequence_id rises along it."""
    rows, n = _placed(docs)
    pieces = rows.mapInArrow(_tokenise(path or tokenizer_path(), capacity, end_id), PIECES + ", place long")
    groups = max(1, -(-n // group_docs))
    return pieces.repartition(groups, F.floor(F.col("place") / group_docs)).mapInArrow(_pack_ranges(capacity, group_docs), PACKED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
