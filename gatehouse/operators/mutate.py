"""The mutation oracle: known defects injected into clean documents.

Draws are hashes of (seed, document, operator, counter), so a document's mutation does not depend on others or on
partitioning. Operators that draw from a vocabulary take its "train" or its "heldout" slice. Seed and slice may be columns: a mutation set over
many of them reads the documents once, and each row evaluates only the operator it has drawn.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gatehouse.functions import counts
from gatehouse.functions import lexicon as X
from gatehouse.sources.adapters import draw, pick

#: Texts of a batch that are Python strings at once.
HELD_TEXTS = 1_000

SLICES = {
    "boilerplate": {"train": X.BOILERPLATE_TRAIN, "heldout": X.BOILERPLATE_HELDOUT},
    "ocr": {"train": X.OCR_TRAIN, "heldout": X.OCR_HELDOUT},
    "risk": {"train": X.RISK_TRAIN, "heldout": X.RISK_HELDOUT},
    "contradiction": {"train": X.CONTRADICTIONS_TRAIN, "heldout": X.CONTRADICTIONS_HELDOUT},
}


def split_vocab(items: Sequence, rate: float = 0.25, seed: int = 0) -> dict[str, tuple]:
    """A vocabulary of one's own in a train and a held-out slice, by a hash of its entries; at least one entry is held out."""
    order = sorted(items, key=lambda x: (hashlib.md5(f"{seed}|{x}".encode()).hexdigest(), str(x)))
    n = max(1, round(len(order) * rate))
    return {"heldout": tuple(order[:n]), "train": tuple(order[n:])}


def _slice(which) -> Column:
    return which if isinstance(which, Column) else F.lit(which)


def _from(vocabulary: str, which, n: Column) -> Column:
    """A drawn entry of the slice that a row asks for."""
    if not isinstance(which, Column):
        return pick(SLICES[vocabulary][which], n)
    return F.when(which == "train", pick(SLICES[vocabulary]["train"], n)).otherwise(pick(SLICES[vocabulary]["heldout"], n))


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(1).cast("long"), n.cast("long"))


def _coin(seed: int, key: str, what: str, k: int) -> int:
    return int(hashlib.md5(f"{seed}|{key}|{what}|{k}".encode()).hexdigest()[:8], 16)


def _begun(seed: int, key: str | None, what: str):
    """The digest of what draw() has before its counter; a null key is left out, as there."""
    return hashlib.md5(("|".join([str(seed), *([] if key is None else [key]), what]) + "|").encode(), usedforsecurity=False)


def _drawn(begun, k: int) -> int:
    h = begun.copy()
    h.update(str(k).encode())
    return int.from_bytes(h.digest()[:4], "big")


def _draw(seed: int, key: str | None, what: str) -> int:
    """draw() in Python."""
    return _drawn(_begun(seed, key, what), 0)


def _draws(seed: int, key: str | None, what: str, n: int) -> list[int]:
    """draw() for the counters 1 to n."""
    begun = _begun(seed, key, what)
    return [_drawn(begun, k) for k in range(1, n + 1)]


def _places(size: int, n: int, items: Sequence[str], seed: int, key: str | None, at: str, what: str) -> list[tuple[int, str]]:
    """n drawn items, each with a drawn place, in the order of places; at one place in that of their counters."""
    drawn = zip(_draws(seed, key, at, n), _draws(seed, key, what, n), strict=True)
    return sorted(((p % max(1, size), items[x % len(items)]) for p, x in drawn), key=lambda d: d[0])


def _inserted(text: str, items: Sequence[str], least: int, each: int, seed: int, key: str | None, what: str) -> tuple[str, list[str]]:
    """text with items before drawn words, at least so many and one for so many words, and the items."""
    words = text.split(" ")
    placed = _places(len(words), max(least, len(words) // each), items, seed, key, what + "@", what)
    out, last = [], 0
    for at, item in placed:
        out += words[last:at]
        out.append(item)
        last = at
    return " ".join(out + words[last:]), [item for _, item in placed]


def tagged(text: str, seed: int, key: str | None) -> tuple[str, list[str]]:
    return _inserted(text, X.INJECTED_TAGS, 3, 25, seed, key, "tag")


def noised(text: str, seed: int, key: str | None, which: str) -> str:
    return _inserted(text, X.INJECTED_GLYPHS, 8, 8, seed, key, "noise")[0]


def misdecoded(text: str, seed: int, key: str | None, which: str) -> str:
    """Fragments before drawn characters: the text is cut at the sorted places, so it is never split into characters."""
    out, last = [], 0
    for at, x in _places(len(text), max(6, len(text) // 80), X.MOJIBAKE, seed, key, "moji@", "moji"):
        out += [text[last:at], x]
        last = at
    return "".join(out) + text[last:]


def _by_text(one: Callable[[str, int, str | None, str], str], text: Column, seed, key: Column, which) -> Column:
    """A Python function of text, seed, key and slice as an Arrow function: a text is walked once, where an expression is interpreted for each word."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series, seed: pd.Series, key: pd.Series, which: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t, int(s), k, w) for t, s, k, w in zip(text, seed, key, which, strict=True)], dtype=object)

    return run(text, (seed if isinstance(seed, Column) else F.lit(seed)).cast("long"), key.cast("string"), _slice(which))


def tag_inject(text: Column, seed, key: Column, which: str) -> Column:
    return _by_text(lambda t, s, k, w: tagged(t, s, k)[0], text, seed, key, which)


def _nav_frame(seed: int, key: str | None, which: str) -> tuple[str, str]:
    light = _draw(seed, key, "light") % 10 < 3
    n = _draw(seed, key, "few") % 2 + 1 if light else _draw(seed, key, "many") % 5 + 4
    phrases = SLICES["boilerplate"][which]
    chrome = [phrases[x % len(phrases)].title() for x in _draws(seed, key, "phrase", n)]
    return "\n".join(chrome[: max(1, n // 2)]) + "\n", "\n" + "\n".join(chrome[n // 2 :])


def _script_frame(seed: int, key: str | None, which: str) -> tuple[str, str]:
    return X.SCRIPT_BLOCK + "\n", ""


def _link_frame(seed: int, key: str | None, which: str) -> tuple[str, str]:
    links = [f"[link {k}](https://ads.example.com/{x % 10**5})" for k, x in enumerate(_draws(seed, key, "link", _draw(seed, key, "links") % 7 + 6))]
    return "", "\n" + "\n".join(links)


#: Operators that put lines before and after a text: what these lines are.
FRAMES = {"nav_boilerplate": _nav_frame, "script_style": _script_frame, "link_dump": _link_frame}


def nav_boilerplate(text: Column, seed, key: Column, which: str) -> Column:
    return _by_text(lambda t, s, k, w: t.join(_nav_frame(s, k, w)), text, seed, key, which)


def script_style(text: Column, seed, key: Column, which: str) -> Column:
    return F.concat(F.lit(X.SCRIPT_BLOCK + "\n"), text)


def link_dump(text: Column, seed, key: Column, which: str) -> Column:
    return _by_text(lambda t, s, k, w: t.join(_link_frame(s, k, w)), text, seed, key, which)


def charsub(text: Column, seed, key: Column, which: str) -> Column:
    """Each confusion in turn, left to right, replaces every other occurrence by chance. The passes depend on one another: an Arrow function."""

    @F.pandas_udf(StringType())
    def run(text: pd.Series, seed: pd.Series, key: pd.Series, which: pd.Series) -> pd.Series:
        def one(t: str, s: int, d: str, w: str) -> str:
            for n, (a, b) in enumerate(SLICES["ocr"][w]):
                parts = t.split(a)
                t = parts[0] + "".join((b if _coin(s, d, f"sub{n}", k) % 2 else a) + p for k, p in enumerate(parts[1:]))
            return t

        return pd.Series([None if t is None else one(t, int(s), d, w) for t, s, d, w in zip(text, seed, key, which, strict=True)])

    return run(text, (seed if isinstance(seed, Column) else F.lit(seed)).cast("long"), key.cast("string"), _slice(which))


def wordbreak(text: Column, seed, key: Column, which: str) -> Column:
    def one(w, i):
        n = F.length(w)
        at = (F.pmod(draw(seed, key, "cut", i), F.greatest(n - 3, F.lit(1)).cast("long")) + 2).cast("int")
        split = lambda glue: F.concat(F.substring(w, F.lit(1), at), F.lit(glue), F.substring(w, at + 1, n))
        chance = lambda what, percent: F.pmod(draw(seed, key, what, i), F.lit(100)) < percent
        return F.when((n > 5) & chance("space", 25), split(" ")).when((n > 6) & chance("hyphen", 10), split("-\n")).otherwise(w)

    return F.array_join(F.transform(F.split(text, " ", -1), one), " ")


def mojibake(text: Column, seed, key: Column, which: str) -> Column:
    return _by_text(misdecoded, text, seed, key, which)


def linenoise(text: Column, seed, key: Column, which: str) -> Column:
    return _by_text(noised, text, seed, key, which)


def truncate(raw: Column, seed, key: Column, which: str) -> Column:
    n = F.length(raw)
    low, high = F.floor(n * 0.3), F.floor(n * 0.9)
    return F.substring(raw, F.lit(1), (low + F.pmod(draw(seed, key, "cut"), high - low + 1)).cast("int"))


def schema_break(raw: Column, seed, key: Column, which: str) -> Column:
    """A key deleted, retyped or set to null. Editing a record in place keeps its other bytes as they are: an Arrow function."""

    @F.pandas_udf(StringType())
    def run(raw: pd.Series, seed: pd.Series, key: pd.Series) -> pd.Series:
        def one(r: str, s: int, d: str) -> str:
            try:
                value = json.loads(r)
            except ValueError:
                return r[: len(r) // 2]
            if not isinstance(value, dict) or not value:
                return r
            name = list(value)[_coin(s, d, "key", 0) % len(value)]
            how = _coin(s, d, "how", 0) % 3
            if how == 0:
                del value[name]
            elif how == 1:
                value[name] = "string-now" if isinstance(value[name], dict) else {"v": value[name]}
            else:
                value[name] = None
            return json.dumps(value, ensure_ascii=False)

        return pd.Series([None if r is None else one(r, int(s), d) for r, s, d in zip(raw, seed, key, strict=True)])

    return run(raw, (seed if isinstance(seed, Column) else F.lit(seed)).cast("long"), key.cast("string"))


def delimiter(raw: Column, seed, key: Column, which: str) -> Column:
    brace = (F.pmod(draw(seed, key, "brace"), F.lit(2)) == 0) & F.endswith(raw, F.lit("}"))
    return F.when(brace, F.substring(raw, F.lit(1), F.length(raw) - 1)).otherwise(F.regexp_replace(raw, r"(?s)^([^,]*),", "$1;"))


def risk(text: Column, seed, key: Column, which: str) -> Column:
    return F.concat(text, F.lit("\n"), _from("risk", which, draw(seed, key, "risk")), F.lit("."))


def contradiction(text: Column, seed, key: Column, which: str) -> Column:
    return F.concat(text, F.lit(" "), _from("contradiction", which, draw(seed, key, "contra")), F.lit("."))


CORRUPTORS = {
    "html": {"tag_inject": tag_inject, "nav_boilerplate": nav_boilerplate, "script_style": script_style, "link_dump": link_dump},
    "ocr": {"charsub": charsub, "wordbreak": wordbreak, "mojibake": mojibake, "linenoise": linenoise},
    "json": {"truncate": truncate, "schema_break": schema_break, "delimiter": delimiter},
    "content": {"risk": risk, "contradiction": contradiction},
}
ARROW = (tag_inject, nav_boilerplate, link_dump, charsub, mojibake, linenoise, schema_break)


def _corrupted(rows: DataFrame, kind: str, seed, which, ops: Sequence[str] | None, hit: Column | None = None) -> DataFrame:
    """rows with a drawn operator applied where `hit`, and its name as operator."""
    pool = {k: CORRUPTORS[kind][k] for k in ops or CORRUPTORS[kind]}
    key = F.col("doc_id")
    drawn = pick(list(pool), draw(seed, key, "operator"))
    rows = rows.withColumn("operator", drawn if hit is None else F.when(hit, drawn))
    target = "raw" if kind == "json" else "text"
    before = F.coalesce(F.nullif(F.col("raw"), F.lit("")), F.col("text")) if kind == "json" else F.col("text")
    made = F.col(target)
    for name, op in pool.items():
        mine = F.coalesce(F.col("operator") == name, F.lit(False))
        # an Arrow function is asked about every row, but gets the texts of its own rows alone
        made = F.when(mine, op(F.when(mine, before) if op in ARROW else before, seed, key, which)).otherwise(made)
    return rows.withColumn(target, made)


def corrupt_by_modality(rows: DataFrame, seed: int, which: Column, hit: Column) -> DataFrame:
    """rows with an operator of their modality applied where `hit`, and its name, else `none`, as operator."""
    out = rows.withColumn("_operator", F.lit("none"))
    for kind in ("html", "ocr", "json"):
        mine = hit & F.coalesce(F.col("modality") == kind, F.lit(False))
        out = _corrupted(out, kind, seed, which, None, mine).withColumn("_operator", F.coalesce("operator", "_operator"))
    return out.withColumn("operator", F.col("_operator")).drop("_operator")


def corrupt(docs: DataFrame, kind: str, seed: int, which: str = "heldout", ops: Sequence[str] | None = None) -> DataFrame:
    """docs, each with one drawn operator applied (to raw for json, else to text), and operator, slice and seed."""
    return _corrupted(docs, kind, seed, which, ops).withColumns({"slice": F.lit(which), "seed": F.lit(seed)})


def _html_counted(pairs: Sequence[tuple[int, str]], pool: Sequence[str]) -> Callable:
    """The work of html_counted: a text's own counts once, for each mutation those of what it changes; equal mutations are counted once."""
    seeds, names = [s for s, _ in pairs], [w for _, w in pairs]

    def of(key: str | None, text: str) -> tuple[list[tuple], list[int]]:
        """Counts, the clean ones first, and which of them each pair has."""
        made, at, seen = [counts.html.counts(text)], [], {}
        for seed, which in pairs:
            op = pool[_draw(seed, key, "operator") % len(pool)]
            mine = (seed,) if op == "tag_inject" else FRAMES[op](seed, key, which)
            if mine not in seen:
                seen[mine] = len(made)
                made.append(counts.html_inserted(*tagged(text, seed, key), made[0]) if op == "tag_inject" else counts.html_framed(mine[0], text, mine[1], made[0]))
            at.append(seen[mine])
        return made, at

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, HELD_TEXTS):
                b = whole.slice(lo, HELD_TEXTS)
                made, at = [], []
                for key, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    own, places = of(key, text or "")
                    at += [len(made)] * len(pairs) + [len(made) + k for k in places]
                    made += own
                table, n = np.array(made, np.int64)[np.array(at, np.int64)], 2 * b.num_rows
                fields = [pa.array(np.ascontiguousarray(table[:, k])) for k in range(table.shape[1])]
                columns = [
                    b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), 2 * len(pairs)))), pa.array(np.tile(np.array(seeds, np.int32), n)), pa.array(names * n),
                    pa.array(np.tile(np.repeat(np.array([0, 1], np.int32), len(pairs)), b.num_rows)), pa.StructArray.from_arrays(fields, names=list(counts.HTML)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "seed", "slice", "defect", "_n"])

    return run


def html_counted(docs: DataFrame, seeds: Sequence[int], slices: Sequence[str] = ("heldout",), ops: Sequence[str] | None = None) -> DataFrame:
    """doc_id, seed, slice, defect and _n, the counts of the HTML gate: what counting each text of mutation_set() gives, in one walk over docs.

    A text goes to Python once. Lines before and after it and tags put into it change its counts by what they hold, so words aren't counted anew for each mutation.
    """
    pairs = [(int(s), w) for s in seeds for w in slices]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, seed int, slice string, defect int, _n struct<{', '.join(f'{k}: bigint' for k in counts.HTML)}>"
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), "text").mapInArrow(_html_counted(pairs, list(ops or CORRUPTORS["html"])), schema)


def mutation_set(docs: DataFrame, kind: str, seeds: Sequence[int], slices: Sequence[str] = ("heldout",), ops: Sequence[str] | None = None, clean: bool = True) -> DataFrame:
    """For every seed and slice each document corrupted (defect 1) and, if wanted, clean (defect 0), in one reading of docs."""
    wanted = [F.struct(F.lit(int(s)).alias("seed"), F.lit(w).alias("slice"), F.lit(d).alias("defect")) for s in seeds for w in slices for d in ((0, 1) if clean else (1,))]
    rows = docs.select("*", F.explode(F.array(*wanted)).alias("_m")).select(*docs.columns, "_m.seed", "_m.slice", "_m.defect")
    return _corrupted(rows, kind, F.col("seed"), F.col("slice"), ops, F.col("defect") == 1)
