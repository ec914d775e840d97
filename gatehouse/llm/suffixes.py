"""Removal of repeated byte strings by suffix arrays and longest-previous-factor arrays, over shards of the corpus.

A text is a string of symbols: its bytes, and on request also its words, runs without white space, each known by a 64-bit hash. Both
go through the same steps, a region's anchor hash telling in its lowest bit which they are.

A string of `length` bytes repeats if it also starts anywhere else. Windows of that length are brought together by their
content: each window chooses the smallest-hashed `GRAM`-byte string in it (its anchor), so equal windows choose equal anchors
at the same place. Consecutive windows with one anchor are a region, known by the hashes of its anchor and of its bytes.

1. A region that occurs twice repeats as a whole. Regions are counted with partial sums, so copies of whole texts,
   however many, never meet in a task.
2. Where an anchor has different regions, one of each is cut out of its text and dealt to shards by anchor. A
   shard builds the suffix array of its regions (separated by symbols of their own), the LCP of neighbours, and from the
   previous and next smaller positions in suffix order the longest-previous-factor array: every position's longest match with an
   earlier one. Positions whose factor is `length` or more are later copies; the matched earlier positions are the
   first ones.
3. An anchor with more than `HOT` different regions isn't dealt to one shard: its windows are counted by hash,
   first in runs of `RUN` windows by the bytes these share, then one by one where that repeats.

keep "none" removes every byte of a repeated string, "first" keeps the string that comes first by (doc_id, text hash,
position). Hashes are 64 bits of polynomial hashes; a region is known by two, its anchor's and its own. Null texts count as empty; texts
shorter than `length` lose nothing; rows with equal doc_id and text, without doc_id too, count as copies, but are cut and spelled out
once; texts are shuffled compressed; a text longer than a pass is taken in ranges that overlap by `length` - 1; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

LENGTH, GRAM, HOT, RUN, SHARD_BYTES = 400, 128, 256, 16, 1_000_000
WORD_GRAM, LONG_WORD = 8, 256
BYTE_UNIT, WORD_UNIT = 0, 1
_powers, _other = common.Powers(), common.Powers(0xD1342543DE82EF95)
_TABLE = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class Hashes:
    """Hashes of the spans of an array of 64-bit symbol codes, by two bases."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, {}

    def spans(self, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
        if base not in self.parts:
            n = len(self.codes)
            up, down = (_powers, _other)[base].reach(n + 1)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(self.codes * up[:n], out=prefix[1:])
            self.parts[base] = (prefix, down)
        prefix, down = self.parts[base]
        return common.mix64((prefix[ends] - prefix[starts]) * down[starts])


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts that data holds, and the first word of each text (one more at the end)."""
    inside, inner = ~_SPACE[data], offsets[(offsets > 0) & (offsets < len(data))]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    begin[inner], stop[inner - 1] = inside[inner], inside[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    codes, short = np.empty(len(starts), np.uint64), ends - starts <= LONG_WORD
    for a in range(0, len(data), common.PASS_BYTES):
        lo, hi = np.searchsorted(starts, [a, a + common.PASS_BYTES])
        w = lo + np.flatnonzero(short[lo:hi])
        codes[w] = Hashes(_TABLE[data[a : a + common.PASS_BYTES + LONG_WORD]]).spans(starts[w] - a, ends[w] - a)
    for w in np.flatnonzero(~short).tolist():
        codes[w] = int.from_bytes(hashlib.blake2b(data[starts[w] : ends[w]].tobytes(), digest_size=8).digest(), "little")
    return codes, np.searchsorted(starts, offsets)


def symbols_of(raw: bytes, unit: int) -> np.ndarray:
    """Symbols of a cut-out region: its bytes, or its words' hashes."""
    return np.frombuffer(raw, np.uint64 if unit else np.uint8)


def _codes(raw: bytes, unit: int) -> np.ndarray:
    return symbols_of(raw, unit) if unit else _TABLE[symbols_of(raw, unit)]


def stretches(bounds: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Texts (row, start, end) whose symbols lie together in a pass; of a text longer than that, ranges of it that hold each window once."""
    for lo, hi in common.passes(bounds):
        a, b = int(bounds[lo]), int(bounds[hi])
        if hi == lo + 1 and b - a > common.PASS_BYTES:
            for s in range(a, b - length + 1, common.PASS_BYTES):
                yield [(lo, s, min(b, s + common.PASS_BYTES + length - 1))]
        else:
            yield [(i, int(bounds[i]), int(bounds[i + 1])) for i in range(lo, hi) if bounds[i + 1] - bounds[i] >= length]


def anchors(grams: np.ndarray, windows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The regions of one text from its gram hashes: each anchor's position, its first window and its last window."""
    m = len(grams)
    low = np.uint64((1 << 28) - 1)
    # the hash above, the position below: the leftmost of equal grams wins in every window
    key = (grams & ~low) | np.arange(m, dtype=np.uint64)
    rows = -(-m // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max)
    padded[:m] = key
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return (least[change] & low).astype(np.int64), change, np.concatenate([change[1:], [windows]]) - 1


#: place: the first window << 32 | how many windows follow it << 16 | the windows before the anchor
REGIONS = "doc_id long, mark long, h long, r long, place long"


def _regions(units: list[tuple[int, int]]):
    """units: the shortest repeat and the anchor's size, in bytes and, if asked for, in words."""

    def found(codes, bounds: np.ndarray, unit: int) -> Iterator[tuple[np.ndarray, ...]]:
        length, gram = units[unit]
        for texts in stretches(bounds, length):
            if not texts:
                continue
            origin = texts[0][1]
            h = Hashes(codes(origin, texts[-1][2]))
            grams = h.spans(np.arange(len(h.codes) - gram + 1), np.arange(gram, len(h.codes) + 1))
            parts = []
            for row, a, b in texts:
                at, first, last = anchors(grams[a - origin : b - origin - gram + 1], b - a - length + 1, length - gram + 1)
                places = (first + a - bounds[row] << 32) | (last - first << 16) | (at - first)
                parts.append((np.full(len(at), row), at + a - origin, first + a - origin, last + a - origin, places))
            row, at, s, e, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            anchor = (h.spans(at, at + gram) & ~np.uint64(1)) | np.uint64(unit)
            yield row, anchor, h.spans(s, e + length) + (at - s).astype(np.uint64) * _SALT, places

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for lo, hi in common.passes(offsets):
                whole, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                for unit in range(len(units)):
                    if unit == BYTE_UNIT:
                        made = found(lambda a, b, whole=whole: _TABLE[whole[a:b]], bounds, unit)
                    else:
                        words, firsts = word_codes(whole, bounds)
                        made = found(lambda a, b, words=words: words[a:b], firsts, unit)
                    for row, h, r, places in made:
                        at = pa.array(row + lo)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h.view(np.int64)), pa.array(r.view(np.int64)), pa.array(places)], names=[x.split()[0] for x in REGIONS.split(", ")])

    return run


SLICES = "h long, doc_id long, mark long, first int, bytes binary, before int, kinds long"


PACKED, SIZE_BYTES = "doc_id long, mark long, text binary", 4


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, mark and text with texts compressed for a shuffle: their size, then the bytes by zstd, which are two thirds of what the shuffle's own blocks make of them."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        for lo, hi in common.passes(common.utf8(batch.column(2))[1]):
            part = batch.slice(lo, hi - lo)
            texts = part.column(2).cast(pa.binary()).to_pylist()
            packed = pa.array([len(t).to_bytes(SIZE_BYTES, "little") + codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=[x.split()[0] for x in PACKED.split(", ")])


def unpacked(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches whose column `at` holds texts, those of _pack() as bytes again, of one pass at a time."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        if not pa.types.is_binary(batch.column(at).type):
            yield batch
            continue
        packed = batch.column(at).to_pylist()
        sizes = [int.from_bytes(x[:SIZE_BYTES], "little") for x in packed]
        for lo, hi in common.passes(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)):
            columns = batch.slice(lo, hi - lo).columns
            columns[at] = pa.array([codec.decompress(x[SIZE_BYTES:], n, asbytes=True) for x, n in zip(packed[lo:hi], sizes[lo:hi], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _slices(units: list[tuple[int, int]]):
    """Cuts regions out of their texts. Rows: doc_id, mark, text (packed or not), regions (h, place, kinds)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
        for batch in unpacked(batches, 2):
            data, offsets = common.utf8(batch.column(2))
            for lo, hi in common.passes(offsets, common.PASS_BYTES >> 2):
                whole, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                texts = [(whole, bounds)]
                if len(units) > 1:
                    texts.append(word_codes(whole, bounds))
                rows = []
                for i, (doc_id, mark, regions) in enumerate(zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1, 3)), strict=True)):
                    for r in regions:
                        unit, first = r["h"] & 1, r["place"] >> 32
                        symbols, starts = texts[unit]
                        a = starts[i] + first
                        rows.append((r["h"], doc_id, mark, first, symbols[a : a + (r["place"] >> 16 & 0xFFFF) + units[unit][0]].tobytes(), r["place"] & 0xFFFF, r["kinds"]))
                for k in range(0, len(rows), 4096):
                    cols = list(zip(*rows[k : k + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SLICES.split(", ")])

    return run


def suffix_array(symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of symbols (separators unique), told apart up to `most` symbols at least, and the LCP of neighbours, up to a bound above it.

    Prefix doubling from three symbols on; the ranks of every step are kept, and the LCPs are read off them.
    """
    n = len(symbols)
    s = np.zeros(n + 2, np.uint64)
    s[:n] = symbols.astype(np.uint64) + np.uint64(1)
    key = (s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:]
    ranks, width = [], 3
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append((width, rank.astype(np.int32)))
        if width > most or rank[order[-1]] == n - 1:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        width *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for width, rank in reversed(ranks):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        lcp[1:] += width * same
        a[same] += width
        b[same] += width
    same = np.ones(n - 1, bool)
    for _ in range(2):  # what is left is less than three symbols
        same &= (a < n) & (b < n)
        same[same] = symbols[a[same]] == symbols[b[same]]
        lcp[1:] += same
        a[same] += 1
        b[same] += 1
    return order, lcp


def longest_previous_factor(order: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position the length of its longest match with an earlier position, where that is `least` or more, and that position (else 0 and -1).

    In suffix order the best earlier match of a position is its previous or its next smaller position; the match length is the
    smallest LCP on the way. Neighbours with an LCP below `least` split the order into runs that are treated alone.
    """
    n = len(order)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    long = lcp >= least
    inside = long | np.concatenate([long[1:], [False]])
    stack: list[tuple[int, int]] = []  # positions that rise, each with the LCP to the one below it
    for k in np.flatnonzero(inside).tolist():
        p, to = int(order[k]), int(lcp[k])
        if to < least:
            stack = []
        while stack and stack[-1][0] > p:  # p is the next smaller position of what is popped
            q, below = stack.pop()
            if to > length[q]:
                length[q], source[q] = to, p
            to = min(to, below)
        if stack and to > length[p]:  # the top is the previous smaller position of p
            length[p], source[p] = to, stack[-1][0]
        stack.append((p, to if stack else 0))
    return length, source


def repeats(regions: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window start in the concatenated regions (bytes, or arrays of symbols): whether it copies an earlier one, whether a later one copies it; and where regions start and end in it."""
    sizes = np.array([len(r) for r in regions])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.empty(int(sizes.sum()) + len(regions), np.int64)
    text = np.ones(len(symbols), bool)
    text[starts + sizes] = False
    flat = np.concatenate([np.frombuffer(r, np.uint8) if isinstance(r, bytes) else r for r in regions])
    symbols[text] = flat if flat.dtype == np.uint8 else np.unique(flat, return_inverse=True)[1]
    symbols[~text] = (256 if flat.dtype == np.uint8 else len(flat)) + np.arange(len(regions))
    order, lcp = suffix_array(symbols, length)
    factor, source = longest_previous_factor(order, lcp, length)
    later = factor >= length
    first = np.zeros(len(symbols), bool)
    first[source[later]] = True
    return later, first, starts, sizes


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Inclusive ranges of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


SPANS = "doc_id long, mark long, unit int, first int, last int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=[x.split()[0] for x in SPANS.split(", ")])


def _shards(units: list[tuple[int, int]], keep: str):
    """Rows come by anchor, doc_id, mark, first. Shards are cut at anchors once they hold SHARD_BYTES."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for unit, (length, _) in enumerate(units):
            own = [r for r in rows if r[0] & 1 == unit]
            if not own:
                continue
            later, first, starts, sizes = repeats([symbols_of(r[4], unit) for r in own], length)
            hit = later if keep == "first" else later | first
            for (_, doc_id, mark, at, _), s, n in zip(own, starts.tolist(), sizes.tolist(), strict=True):
                out += [(doc_id, mark, unit, at + a, at + b) for a, b in _runs(hit[s : s + n - length + 1])]
        return _spans(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total > SHARD_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[4])
        if rows:
            yield solve(rows)

    return run


PIECES = "doc_id long, mark long, unit int, first int, last int, core long, r1 long, r2 long, bytes binary"
WINDOWS = "doc_id long, mark long, unit int, first int, w1 long, w2 long"


def _pieces(units: list[tuple[int, int]], most: int):
    """Regions cut into runs of at most `most` windows, or half a repeat, by their distance from the anchor. The core is what all windows of a full run share.

    Rows: h, doc_id, mark, first, bytes, before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for h, doc_id, mark, first, raw, before in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    unit = h & 1
                    length, size = units[unit][0], 8 if unit else 1
                    run_of = min(most, max(1, length // 2))
                    hashes = Hashes(_codes(raw, unit))
                    windows = len(hashes.codes) - length + 1
                    cut = np.array(sorted({0, windows, *range((before + 1) % run_of, windows, run_of)}))
                    a, b = cut[:-1], cut[1:]
                    number = (before - a) // run_of
                    head, tail = before - number * run_of, before - number * run_of - run_of + 1  # last and first window of the full run
                    salt = number.astype(np.uint64) * _SALT + np.uint64(h & (2**64 - 1))
                    core = hashes.spans(head, tail + length) + salt
                    r1 = hashes.spans(a, b - 1 + length) + (a - tail).astype(np.uint64) * _SALT
                    r2 = hashes.spans(a, b - 1 + length, 1)
                    out += [(doc_id, mark, unit, first + x, first + y - 1, c, p, q, raw[x * size : (y - 1 + length) * size]) for x, y, c, p, q in zip(a.tolist(), b.tolist(), core.view(np.int64).tolist(), r1.view(np.int64).tolist(), r2.view(np.int64).tolist(), strict=True)]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def _windows(units: list[tuple[int, int]]):
    """Hashes of every window. Rows: doc_id, mark, unit, first, bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, mark, unit, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, length = Hashes(_codes(raw, unit)), units[unit][0]
                at = np.arange(len(h.codes) - length + 1)
                n = len(at)
                hashes = [pa.array(h.spans(at, at + length, k).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array([unit] * n, pa.int32()), pa.array((at + first).astype(np.int32)), *hashes], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return run


def _place(at: str):
    return F.struct("doc_id", "mark", at)


def _by_windows(slices: DataFrame, units: list[tuple[int, int]], keep: str) -> DataFrame:
    """Spans within regions of hot anchors, found by counts alone, so that no group meets in a task."""
    pieces = common.cut(slices.select("h", "doc_id", "mark", "first", "bytes", "before").mapInArrow(_pieces(units, RUN), PIECES))
    kinds = common.cut(pieces.groupBy("core", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(_place("first")).alias("one")))
    many = common.cut(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    kept = common.cut(pieces.join(kinds, ["core", "r1", "r2"]).withColumn("rep", _place("first") == F.col("one")))
    copies = kept.where("n > 1" if keep == "none" else "not rep").select("doc_id", "mark", "unit", "first", "last")
    windows = common.cut(kept.where("rep").join(many, "core").select("doc_id", "mark", "unit", "first", "bytes").mapInArrow(_windows(units), WINDOWS))
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(_place("first")).alias("one")).where("n > 1")
    found = windows.join(common.cut(again), ["w1", "w2"])
    if keep == "first":
        found = found.where(_place("first") != F.col("one"))
    return copies.unionByName(found.select("doc_id", "mark", "unit", "first", F.col("first").alias("last")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "first", gram: int = GRAM, hot: int = HOT, words: int | None = None) -> DataFrame:
    """Ranges first .. last of window starts whose strings repeat: doc_id, mark (a hash of the text), unit, first, last.

    unit 0 counts bytes, for repeats of `length` bytes; unit 1, only with `words`, counts words, for repeats of that many. Both are 65,536 at most.
    A range may come more than once.
    """
    if max(length, words or 0) > 1 << 16:
        raise ValueError("repeats are looked for up to a length of 65536")
    spark = docs.sparkSession
    units = [(length, min(gram, max(1, length // 2)))]
    if words:
        units.append((words, min(WORD_GRAM, max(1, words // 2))))
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    regions = common.written(base.mapInArrow(_regions(units), REGIONS), "regions")
    kinds = common.written(regions.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"), F.min(_place("place")).alias("one")), "kinds")
    copies = regions.join(kinds.where("n > 1").select("h", "r", "one"), ["h", "r"])
    if keep == "first":
        copies = copies.where(_place("place") != F.col("one"))
    first, last = F.expr("CAST(place >> 32 AS int)"), F.expr("CAST((place >> 32) + (place >> 16 & 65535) AS int)")
    copies = copies.select("doc_id", "mark", F.expr("CAST(h & 1 AS int)").alias("unit"), first.alias("first"), last.alias("last"))
    many = common.cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1"))
    mixed = kinds.join(many, "h")
    if keep == "none":  # anchors all of whose regions repeat are settled
        mixed = mixed.where("least = 1")
    # rows that repeat an id and its text are one text here, dropped before they are shuffled
    key = ["id", "none", "mark"]
    named = lambda id_: (F.coalesce(id_, F.lit(0)).alias("id"), F.isnull(id_).alias("none"))
    wanted = common.cut(mixed.select(*named(F.col("one.doc_id")), "one.mark", F.struct("h", F.col("one.place").alias("place"), "kinds").alias("r")).groupBy(*key).agg(F.collect_list("r").alias("regions")))
    texts = base.mapInArrow(_pack, PACKED).select(*named(F.col("doc_id")), "mark", "text").groupBy(*key).agg(F.first("text").alias("text")).join(wanted, key)
    slices = common.cut(texts.select(F.expr("CASE WHEN NOT none THEN id END").alias("doc_id"), "mark", "text", "regions").mapInArrow(_slices(units), SLICES))
    dealt = slices.where(F.col("kinds") <= hot).select("h", "doc_id", "mark", "first", "bytes").repartition(common.partitions(spark), "h").sortWithinPartitions("h", "doc_id", "mark", "first")
    spans = copies.unionByName(dealt.mapInArrow(_shards(units, keep), SPANS))
    large = slices.where(F.col("kinds") > hot)
    if large.limit(1).count():
        spans = spans.unionByName(_by_windows(large, units, keep))
    return spans


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered(spans: list | None, length: int, unit: int = BYTE_UNIT) -> list[list[int]]:
    """The ranges start, end that repeated strings of `length` symbols cover, merged where they overlap or touch."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in spans or [] if r["unit"] == unit):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return out


def _removed(raw: bytes, spans: list, length: int) -> np.ndarray:
    """Which bytes a repeated string covers."""
    gone = np.zeros(len(raw), bool)
    for a, b in covered(spans, length):
        gone[a:b] = True
    return gone


def _digest(length: int, words: int | None = None):
    """Per row what is left of a text; with `words` also how many words repeated passages of that many cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * bool(words), [x.split()[0] for x in OUT.split(", ")] + ["n_repeated_words"] * bool(words)
        for batch in unpacked(batches, 1):
            data, offsets = common.utf8(batch.column(1))
            for lo in range(0, batch.num_rows, 256):
                out = []
                for i, (doc_id, spans) in enumerate(zip(*(batch.column(c).slice(lo, 256).to_pylist() for c in (0, 2)), strict=True), lo):
                    raw, gone = memoryview(data[offsets[i] : offsets[i + 1]]), covered(spans, length)
                    kept, at = hashlib.sha256(), 0
                    for a, b in [*gone, [len(raw), len(raw)]]:
                        kept.update(raw[at:a])
                        at = b
                    row = (doc_id, len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest())
                    out.append((*row, sum(b - a for a, b in covered(spans, words, WORD_UNIT))) if words else row)
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def marked(docs: DataFrame, length: int = LENGTH, keep: str = "first", packed: bool = False, **options) -> DataFrame:
    """doc_id, text and the spans (unit, first, last) of repeated strings in it, for every row; each distinct span once, however many rows are equal. packed: texts stay as they were shuffled, by _pack()."""
    key = ["id", "none", "mark"]
    spans = repeated_spans(docs, length, keep, **options).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("none"), "mark", F.struct("unit", "first", "last").alias("span"))
    by = common.cut(spans.groupBy(*key).agg(F.collect_set("span").alias("spans")))
    text, id_ = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    if packed:
        rows = rows.mapInArrow(_pack, PACKED)
    base = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("none"), "mark", "text")
    return base.join(by, key, "left").select(F.expr("CASE WHEN NOT none THEN id END").alias("doc_id"), "text", "spans")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(common.table(spark, sf_dir, "documents"), keep="none", packed=True).mapInArrow(_digest(LENGTH), OUT)
