"""Fill-in-middle transformation by a numpy kernel over the UTF-8 bytes of a whole Arrow batch.

Units are runs of ASCII letters, and every other character alone. A lookup table gives each byte's class; a unit begins at a byte that is no
continuation byte, unless it and the byte before it in the same document are letters. Cumulative sums of that mask, reset at documents,
number the units, and searchsorted finds the bytes at which the units of all rows' cuts begin. The mask is made for blocks of a bounded
number of bytes, which may begin and end anywhere, so a text of any length needs memory for its bytes alone. Sentinels and parts are copied
into one buffer, which becomes the Arrow column.

Cuts and forms are drawn from the sha256 of a seed and doc_id, so any partitioning gives the same rows; nothing is shuffled. Null and empty
texts are plain and have no units; a null doc_id draws as an empty string; texts that hold a sentinel stay plain, so that an output can be
taken apart again; repeated rows get equal results; other columns, of any name, are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of a hundred of these so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1:"
FORMS = PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes whose units are numbered at once, and bytes of text that make one output batch; a longer document is a batch of its own.
BLOCK_BYTES, PASS_BYTES = 1 << 18, 1 << 22
#: Parts of at least so many bytes are copied as slices, shorter ones by an index of bytes.
LONG = 256
OUT = "doc_id long, form string, n_units long, prefix_chars long, middle_chars long, output string"

LETTER, LEAD = 1, 2
_CLASS = np.full(256, LEAD, np.uint8)
_CLASS[0x80:0xC0] = 0  # continuation bytes
for _low, _high in ("AZ", "az"):
    _CLASS[ord(_low) : ord(_high) + 1] = LEAD | LETTER


class Units:
    """Where units and characters of a batch begin. data: bytes of all documents; offsets: the n + 1 bounds of the documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.blocks = np.arange(0, len(data) + BLOCK_BYTES, BLOCK_BYTES).clip(max=len(data))
        self.kept: tuple = (None,)
        units, chars = [0], [0]
        for k in range(len(self.blocks) - 1):
            mask, lead = self._masks(k)
            units.append(units[-1] + int(np.count_nonzero(mask)))
            chars.append(chars[-1] + int(np.count_nonzero(lead)))
        self.units, self.chars = np.array(units, np.int64), np.array(chars, np.int64)  # before each block

    def _masks(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a unit, and a character, begins at each byte of a block."""
        lo, hi = self.blocks[k], self.blocks[k + 1]
        kind = _CLASS[self.data[max(lo - 1, 0) : hi]]
        letter, lead = (kind & LETTER) > 0, kind >= LEAD
        joined = np.concatenate([[False], letter[1:] & letter[:-1]])
        if lo:
            joined, lead = joined[1:], lead[1:]
        first = self.offsets[np.searchsorted(self.offsets, lo) : np.searchsorted(self.offsets, hi)]
        joined[first - lo] = False  # documents reset runs
        return lead & ~joined, lead

    def _sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative sums of a block's masks, with a leading 0; the last block asked for is kept."""
        if self.kept[0] != k:
            mask, lead = self._masks(k)
            self.kept = (k, *(np.concatenate([[0], np.cumsum(m, dtype=np.int32)]) for m in (mask, lead)))
        return self.kept[1:]

    def before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units and characters of the batch that begin before each byte of `at`, which ascends."""
        units, chars = np.full(len(at), self.units[-1]), np.full(len(at), self.chars[-1])
        block = np.searchsorted(self.blocks, at, side="right") - 1
        for k in np.unique(block[at < len(self.data)]):
            own = (block == k) & (at < len(self.data))
            u, c = self._sums(k)
            units[own], chars[own] = self.units[k] + u[at[own] - self.blocks[k]], self.chars[k] + c[at[own] - self.blocks[k]]
        return units, chars

    def begins(self, number: np.ndarray) -> np.ndarray:
        """The byte at which each unit of `number`, ascending and counted over the batch, begins; the end of the data beyond the last."""
        out = np.full(len(number), len(self.data), np.int64)
        block = np.searchsorted(self.units, number, side="right") - 1
        for k in np.unique(block[number < self.units[-1]]):
            own = (block == k) & (number < self.units[-1])
            out[own] = self.blocks[k] + np.searchsorted(self._sums(k)[0], number[own] - self.units[k] + 1) - 1
        return out


def _rows_with_sentinels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold a sentinel."""
    marks = np.frombuffer("".join(SENTINELS).encode(), np.uint8).reshape(-1, 3)  # three bytes each
    hit = np.zeros(len(offsets) - 1, bool)
    for lo in range(0, len(data), BLOCK_BYTES):
        part = data[lo : lo + BLOCK_BYTES + 2]
        at = np.flatnonzero((part[:-2] == marks[0, 0]) & (part[2:] == marks[0, 2]) & np.isin(part[1:-1], marks[:, 1])) + lo
        row = np.searchsorted(offsets, at, side="right") - 1
        hit[row[at + 3 <= offsets[row + 1]]] = True
    return hit


def gathered(source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The parts source[begin[i] : begin[i] + length[i]], one after another, in one buffer."""
    end = np.cumsum(length)
    at = end - length
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    long = length >= LONG
    for i in np.flatnonzero(long).tolist():
        out[at[i] : end[i]] = source[begin[i] : begin[i] + length[i]]
    b, n, to = begin[~long], length[~long], at[~long]
    rows = max(1, BLOCK_BYTES // LONG)
    for lo in range(0, len(n), rows):
        m = n[lo : lo + rows]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[step + np.repeat(to[lo : lo + rows], m)] = source[step + np.repeat(b[lo : lo + rows], m)]
    return out


def transform_batch(ids: pa.Array, texts: pa.Array, draws: list[np.ndarray], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> pa.RecordBatch:
    """A row for each text. draws: two numbers that choose the cuts, one for plain or not, one for the order of parts."""
    data, offsets = common.utf8(texts)
    begin, end = offsets[:-1], offsets[1:]
    units = Units(data, offsets)
    unit_at, char_at = units.before(offsets)
    n, base = np.diff(unit_at), unit_at[:-1]
    first, second = (d % (n + 1) for d in draws[:2])
    cut = [np.where(c == n, end, np.minimum(units.begins(base + c), end)) for c in (np.minimum(first, second), np.maximum(first, second))]
    plain = (n == 0) | (draws[2] % 100 >= rate) | _rows_with_sentinels(data, offsets)
    spm = ~plain & (draws[3] % 100 < suffix_first)
    chars = [units.before(c)[1] - char_at[:-1] for c in cut]

    prefix, middle, suffix = (begin, cut[0] - begin), (cut[0], cut[1] - cut[0]), (cut[1], end - cut[1])
    p, s, m = (len(data) + 3 * k for k in range(3))  # sentinels lie after the texts
    either = lambda x, y: tuple(np.where(spm, u, v) for u, v in zip(x, y, strict=True))
    mark = np.where(plain, 0, 3)
    sign = lambda x, y: (np.where(spm, x, y), mark)
    whole = (begin, np.where(plain, end - begin, 0))
    parts = [whole, sign(s, p), either(suffix, prefix), sign(p, s), either(prefix, suffix), sign(m, m), middle]
    starts = np.stack([b for b, _ in parts], axis=1)
    lengths = np.stack([parts[0][1], *[np.where(plain, 0, x) for _, x in parts[1:]]], axis=1)
    out = gathered(np.concatenate([data, np.frombuffer("".join(SENTINELS).encode(), np.uint8)]), starts.ravel(), lengths.ravel())
    bounds = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))]).astype(np.int64)
    output = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    form = pa.array(FORMS).take(pa.array(np.where(plain, 0, np.where(spm, 2, 1))))
    sizes = [pa.array(x.astype(np.int64), mask=plain) for x in (chars[0], chars[1] - chars[0])]
    return pa.RecordBatch.from_arrays([ids, form, pa.array(n.astype(np.int64)), *sizes, output.cast(pa.string())], names=[x.split()[0] for x in OUT.split(", ")])


def _transform(rate: int, suffix_first: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in common.passes(common.utf8(b.column(1))[1], PASS_BYTES):
                rows = b.slice(lo, hi - lo)
                yield transform_batch(rows.column(0), rows.column(1), [rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5)], rate, suffix_first)

    return run


def fill_in_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, form (plain, psm or spm), n_units, prefix_chars and middle_chars (null if plain), output: a row for each of docs."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws).mapInArrow(_transform(rate, suffix_first), OUT)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"<[{''.join(s[1] for s in SENTINELS)}]>", -1)
    psm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))
    spm = F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents"))
    digests = [F.sha2(x.cast("binary"), 256).alias(n) for x, n in ((F.col("output"), "output_sha256"), (restored(F.col("form"), F.col("output")), "restored_sha256"))]
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digests)
