"""Alignment of two tokenizers over the same texts: which ids of one stand for which ids of the other, and how often.

Python only tokenises. Each text becomes two arrays of ids and two of byte ends; from there on everything is higher-order functions and
joins. array_intersect of the ends gives the offsets at which both vocabularies agree; a sort of these with the ends of one side places
them among its tokens, since an offset that both have stands twice in a row; sequence and filter find these places, transform and slice cut
both sides there into groups, spell them out and link them, aggregate counts. All of it is linear in the tokens, but for the sort. A link is a
pair of tokens whose group is the same. Within a group equal ids are counted first, so a group of many repeated tokens gives a link for each
two ids and their number, never all pairs.

A pair's count is the number of documents (rows) that hold it linked. Pairs are made distinct in each document, then counted with partial
sums; a pair held by more than one in 10,000 of these is broadcast back, at most 10,000 are, and the others are joined by a shuffle.

Both sides see a space before the text. Texts that are null or empty, or that a tokenizer changes (its tokens' bytes differ from those of
space + text), have no tokens: zeros and an empty digest. Control strings within texts are plain text. Long texts are tokenised in parts
that end before a space between two ASCII letters, where no token of either side goes on; that gives the ids of the whole text. Repeated
rows, also of one doc_id or without one, are documents of their own; other columns, of any name, are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common
from gatehouse.llm.bytebpe import byte_bpe

#: Characters of a part of a long text, about, and bytes of text that are tokenised at once.
PART_CHARS, PASS_BYTES = 200_000, 250_000
_SEAM = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
TOKENS = "doc_id long, a array<int>, a_end array<int>, b array<int>, b_end array<int>"
WORD_SPACE = "▁"


def paths() -> tuple[str, str]:
    """The public byte-level BPE, and the public piece BPE with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _piece_bytes(pieces) -> list[bytes]:
    """The bytes of every id of a piece model."""
    ids = range(pieces.get_piece_size())
    return [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace(WORD_SPACE, " ").encode() for i in ids]


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str) -> list[tuple[Callable, np.ndarray, np.ndarray]]:
    """For each side: texts -> ids and offsets, and the bytes of its vocabulary."""
    import sentencepiece

    bpe, pieces = byte_bpe(path_a, True), sentencepiece.SentencePieceProcessor(model_file=path_b)

    def by_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = pieces.encode([t[1:] for t in texts], num_threads=1)  # it adds the space itself
        return np.fromiter((i for g in got for i in g), np.int64, sum(map(len, got))), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)

    return [(bpe.ids, *_table(bpe.token_bytes())), (by_pieces, *_table(_piece_bytes(pieces)))]


def parts_of(text: str, chars: int = PART_CHARS) -> list[str]:
    """space + text, cut before spaces between letters into parts of about so many characters."""
    text, cuts = " " + text, [0]
    while len(text) - cuts[-1] > chars:
        seam = _SEAM.search(text, cuts[-1] + chars)
        if seam is None:
            break
        cuts.append(seam.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _tokens(side: tuple, parts: list[str], owner: np.ndarray, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, byte ends within the document, and token bounds of each document of a pass; and whether each document's bytes are kept. raw, ends: the documents' bytes and where they end."""
    encode, table, first = side
    ids, offsets = encode(parts)
    ids = ids.astype(np.int64)
    size = (first[1:] - first[:-1])[ids]
    to = np.concatenate([[0], np.cumsum(size)])
    bounds = offsets[np.searchsorted(owner, np.arange(len(ends) + 1))]  # parts to documents
    made = table[np.arange(to[-1]) + np.repeat(first[ids] - to[:-1], size)].tobytes()
    at, begin = to[bounds].tolist(), [0, *ends[:-1].tolist()]
    kept = np.array([made[at[i] : at[i + 1]] == raw[begin[i] : e] for i, e in enumerate(ends.tolist())], bool)
    return ids, to[1:] - np.repeat(to[bounds[:-1]], np.diff(bounds)), bounds, kept


def _lists(values: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> pa.Array:
    """A list for each document, empty where it isn't kept."""
    n = np.diff(bounds)
    values = values[np.repeat(kept, n)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(kept, n, 0))]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _tokenise(path_a: str, path_b: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(path_a, path_b)
        for b in batches:
            for lo, hi in common.passes(common.utf8(b.column(1))[1], PASS_BYTES):
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                cut = [parts_of(t) if t else [] for t in texts]
                owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
                parts = [p for c in cut for p in c]
                whole = [p.encode() for p in ("".join(c) for c in cut)]
                raw, ends = b"".join(whole), np.cumsum([len(w) for w in whole])
                found = [_tokens(s, parts, owner, raw, ends) for s in sides]
                kept = found[0][3] & found[1][3]
                lists = [_lists(x, bounds, kept) for ids, to, bounds, _ in found for x in (ids, to)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *lists], names=[x.split()[0] for x in TOKENS.split(", ")])

    return run


def tokenised(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, ids and byte ends of both sides: a row for each of docs."""
    own = paths()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(path_a or own[0], path_b or own[1]), TOKENS)


def _shared_places(ends: str) -> Column:
    """Of the sorted ends of a side and the shared ends the places at which one stands twice, ascending: once for each shared end."""
    every = F.when(F.size(ends) > 1, F.sequence(F.lit(0), F.size(ends) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.get(ends, i) == F.get(ends, i + 1))


def _first(at: str, k: Column) -> Column:
    """The place, from 0, of a group's first id. Up to the k-th shared place lie k shared ends and all ids of the groups up to it."""
    return F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) - k + 2)


def _count(at: str, k: Column) -> Column:
    """The number of ids of a group."""
    return F.get(at, k) - k + 1 - _first(at, k)


def _alone() -> Column:
    """Whether each group is one id on both sides."""
    one = lambda x, at, k: x - F.coalesce(F.get(at, k - 1), F.lit(-2)) == 2
    return F.transform("at_a", lambda x, k: one(x, "at_a", k) & one(F.get("at_b", k), "at_b", k))


def _side(ids: str, k: Column) -> Column:
    """A group's ids; ids: a or b, or their spellings."""
    at = f"at_{ids[0]}"
    return F.slice(ids, _first(at, k) + 1, _count(at, k))


def _pair(x: Column, y: Column) -> Column:
    return F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long"))


def _counted(ids: Column) -> Column:
    """Distinct ids, each with its number of occurrences."""
    return F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("id"), (F.size(ids) - F.size(F.array_remove(ids, x))).cast("long").alias("m")))


def _links(g: Column) -> Column:
    """pair, m: each two ids of a group's sides, and how many token pairs they are."""
    link = lambda x, y: F.struct(_pair(x["id"], y["id"]).alias("pair"), (x["m"] * y["m"]).alias("m"))
    counted = F.array(F.struct(_counted(g["a"]).alias("xs"), _counted(g["b"]).alias("ys")))  # of one entry, so that it is made once
    return F.flatten(F.transform(counted, lambda c: F.flatten(F.transform(c["xs"], lambda x: F.transform(c["ys"], lambda y: link(x, y))))))


def _with(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns that are made once for each row. A generator's output is read as it is, where the optimizer could put a projection's into a lambda, to be made for each entry."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def placed(tokens: DataFrame) -> DataFrame:
    """tokens with a number for each row, at_a and at_b, which say where groups end on both sides, which groups are one id on both, and the ids spelled out."""
    one = _with(tokens.select("*", F.monotonically_increasing_id().alias("row")), F.array_intersect("a_end", "b_end").alias("shared"))
    two = _with(one, *[F.sort_array(F.concat(f"{x}_end", "shared")).alias(f"sorted_{x}") for x in "ab"])
    three = _with(two, *[_shared_places(f"sorted_{x}").alias(f"at_{x}") for x in "ab"])
    return _with(three.select("row", "doc_id", "a", "b", "at_a", "at_b"), _alone().alias("alone"), *[F.col(x).cast("array<string>").alias(f"{x}_said") for x in "ab"])


def grouped(tokens: DataFrame) -> DataFrame:
    """doc_id and groups, an array of both sides' ids, for each row of tokenised()."""
    return placed(tokens).select("doc_id", F.transform("at_a", lambda _, k: F.struct(_side("a", k).alias("a"), _side("b", k).alias("b"))).alias("groups"))


def aligned(tokens: DataFrame) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, ones (pairs of groups of one id on both sides), more (pair and m of other links)."""
    alone, other = (lambda k: F.get("alone", k)), (lambda k: F.get("at_b", k) - k)
    ones = F.filter(F.transform("at_a", lambda x, k: F.when(alone(k), _pair(F.get("a", x - k), F.get("b", other(k))))), lambda p: p.isNotNull())
    rest = F.filter(F.transform("alone", lambda x, k: F.when(~x, k)), lambda k: k.isNotNull())
    groups = F.transform(rest, lambda k: F.struct(_side("a", k).alias("a"), _side("b", k).alias("b")))
    several = lambda k: F.concat(F.array_join(_side("a_said", k), ","), F.lit("|"), F.array_join(_side("b_said", k), ","))
    said = F.array_join(F.transform("at_a", lambda x, k: F.when(alone(k), F.concat(F.get("a_said", x - k), F.lit("|"), F.get("b_said", other(k)))).otherwise(several(k))), ";")
    number = F.aggregate("more", F.size("ones").cast("long"), lambda n, x: n + x["m"])
    made = placed(tokens)
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("a", "n_a"), ("b", "n_b"), ("at_a", "n_groups"))]
    digest = F.when(F.size("at_a") > 0, F.sha2(said, 256)).otherwise("").alias("groups_sha256")
    linked = _with(made, *sizes, digest, ones.alias("ones"), F.flatten(F.transform(groups, _links)).alias("more"))
    number = F.aggregate("more", F.size("ones").cast("long"), lambda n, x: n + x["m"])
    return linked.select("row", "doc_id", "n_a", "n_b", "n_groups", number.alias("n_links"), "groups_sha256", "ones", "more")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its A id). links: as of aligned()."""
    held = links.select(F.explode(F.array_distinct(F.concat("ones", F.transform("more", lambda x: x["pair"])))).alias("pair"))
    counted = common.cut(held.groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftright("pair", 32)
    highest = counted.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    return counted.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its A id), count_sum, groups_sha256."""
    held = common.written(aligned(tokenised(docs, path_a, path_b)), "alignment")
    counts = common.cut(pair_counts(held))
    links = held.select("row", F.explode("ones").alias("pair"), F.lit(1).cast("long").alias("m")).unionByName(held.select("row", F.explode("more").alias("x")).select("row", "x.pair", "x.m"))
    sums = common.join_counted(links, counts, "pair", "n").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return held.drop("ones", "more").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))
