"""Counts over the tokens, words and lines of a text: structs that one Arrow function each makes in a single walk.

A lambda over a token array is interpreted for every token and every test. Here a text is split once, tokens that recur are judged once, and
only counts go back. White space, letters and case are Unicode's. Functions of one projection share one pass of the text to Python.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gatehouse.functions import lexicon as X

#: Distinct tokens whose judgement a worker keeps; beyond that it starts anew, which changes only speed.
KEPT = 1_000_000
#: Texts of a batch that are strings at a time.
HELD = 64

_WORD, _NO_LETTERS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]+"), re.compile(r"([^\W\d_])\1{3}")
_TAG, _ENTITY, _LINK = re.compile(X.TAG), re.compile(X.HTML_ENTITY), re.compile(X.LINK)
_CODE = tuple(c.lower() for c in X.CODE_TOKENS)
_VOWELS, _GLYPHS, _SHORT = frozenset(X.VOWELS), frozenset(X.NOISE_GLYPHS), frozenset(X.SHORT_WORDS)
_STOP, _HTML_STOP = frozenset(X.PROFILE_STOPWORDS), frozenset(X.HTML_STOPWORDS)


def _texts(text: pa.Array) -> Iterator[str]:
    """The texts of a batch, of which HELD at most are strings at a time; a null text is empty."""
    for lo in range(0, len(text), HELD):
        yield from (t or "" for t in text.slice(lo, HELD).to_pylist())


def _struct(*names: str) -> Callable:
    """Makes an Arrow function of text from one that gives a tuple of counts; a null text counts as empty."""
    fields = StructType([StructField(n, LongType()) for n in names])

    def of(one: Callable[[str], tuple]) -> Callable[[Column], Column]:
        @F.arrow_udf(fields)
        def run(text: pa.Array) -> pa.Array:
            made = np.zeros((len(text), len(names)), np.int64)
            for i, t in enumerate(_texts(text)):
                made[i] = one(t)
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(names))], names=list(names))

        run.counts = one
        return run

    return of


#: Bytes of an ASCII text: letters in lower case, and a space for all that parts words.
_LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 for b in range(256))
_STOP_BYTES = frozenset(x.encode() for x in _STOP)


@_struct("tokens", "distinct", "repeats", "words", "word_chars", "stop")
def words(text: str) -> tuple:
    """repeats: tokens equal to the one before."""
    t = text.split()
    if text.isascii():
        w, stops = text.encode().translate(_LETTERS).split(), _STOP_BYTES
        chars = len(b"".join(w))
    else:
        w, stops = _WORD.findall(text.lower()), _STOP
        chars = len("".join(w))
    return len(t), len(set(t)), sum(map(eq, t, islice(t, 1, None))), len(w), chars, sum(map(stops.__contains__, w))


@_struct("tokens", "top")
def pairs(text: str) -> tuple:
    """top: occurrences of the most frequent pair of neighbouring tokens."""
    t = text.split()
    return len(t), max(Counter(zip(t, t[1:], strict=False)).values(), default=0)


@_struct("lines", "full", "distinct", "bullets", "ellipses", "short")
def lines(text: str) -> tuple:
    """full: lines that aren't blank; distinct: different ones of them, without the white space around them."""
    rows = text.split("\n")
    bare = [x.strip() for x in rows]
    full = [x for x in bare if x]
    return len(rows), len(full), len(set(full)), sum(x[:1] in {"-", "*", "•", "‣"} for x in full), sum(x.endswith(("...", "…")) for x in full), sum(len(x) < 12 for x in full)


def _surface(text: str, low: str) -> tuple:
    """The counts of html() but words: what may change wherever something is put into a text."""
    rows = text.split("\n")
    full = [y for x in rows if (y := x.strip())]
    menu = 0
    for x in full:
        if x[-1] not in ".?!:;" and len(t := x.split(None, 8)) <= 8:
            menu += sum(v.lower() in _HTML_STOP for v in t) / len(t) < 0.2
    marks = len(_ENTITY.findall(text)) + sum(low.count(c) for c in _CODE)
    return len(text) - len(_TAG.sub("", text)), marks, sum(low.count(p) for p in X.BOILERPLATE_TRAIN), len(_LINK.findall(text)), len(rows), len(full), menu, len(text)


def _worded(low: str) -> tuple:
    w = _WORD.findall(low)
    return len(w), sum(map(_HTML_STOP.__contains__, w))


HTML = ("tag_chars", "marks", "phrases", "links", "lines", "full", "menu", "chars", "words", "stop")


@_struct(*HTML)
def html(text: str) -> tuple:
    """marks: entities and tokens of code; menu: lines of at most eight tokens without a closing mark and with few function words."""
    low = text.lower()
    return *_surface(text, low), *_worded(low)


@lru_cache(maxsize=10_000)
def _html_of_lines(text: str) -> tuple:
    return html.counts(text)


@lru_cache(maxsize=1_000)
def _item_words(item: str) -> tuple:
    return _worded(item.lower())


def html_framed(head: str, text: str, tail: str, own: tuple) -> tuple:
    """html(head + text + tail), where own is html(text), for a head that ends in a line's end and a tail that begins with one, or that are empty.

    Only tags and links may run over lines, so they alone are looked for anew; of all else the parts' counts add up.
    """
    whole = head + text + tail
    out = [sum(x) for x in zip(_html_of_lines(head), own, _html_of_lines(tail), strict=True)]
    out[0], out[3], out[4] = len(whole) - len(_TAG.sub("", whole)), len(_LINK.findall(whole)), out[4] - 2
    return tuple(out)


def html_inserted(text: str, items: Sequence[str], own: tuple) -> tuple:
    """html(text), where text is one with the counts own that items were put into between spaces: words don't run over these."""
    words, stop = own[-2:]
    for item, n in Counter(items).items():
        w, s = _item_words(item)
        words, stop = words + n * w, stop + n * s
    return *_surface(text, text.lower()), words, stop


def garbage(token: str) -> bool:
    """An implausible token of three letters or more: no vowel, a vowel share out of range, a run of four, or a capital inside."""
    letters = _NO_LETTERS.sub("", token)
    n = len(letters)
    if n < 3:
        return False
    vowels = sum(map(_VOWELS.__contains__, letters))
    if vowels == 0 or (n >= 4 and not 0.18 <= vowels / n <= 0.85):
        return True
    if any(m[0].isalpha() for m in _RUN.findall(token)):
        return True
    inner = letters[1:-1]
    return inner != inner.lower() and letters != letters.upper()


_BITS = 40  # of each count in the sum over a text's tokens
_known: dict[str, int] = {}


def _judged(token: str) -> int:
    letter = _WORD.search(token) is not None
    confused = (letter and any(map(str.isdecimal, token))) + (token in ("1", "0", "l", "|", "I"))
    tiny = len(token) <= 2 and letter and token.lower() not in _SHORT
    out = 0
    for n in (garbage(token), confused, tiny, not token.isascii(), not _GLYPHS.isdisjoint(token)):
        out = out << _BITS | int(n)
    return out


@_struct("tokens", "garbage", "confused", "tiny", "foreign", "noisy", "lines", "hyphens", "glyphs")
def ocr(text: str) -> tuple:
    """Tokens by defect; lines that end in a hyphen; characters of scan noise."""
    if len(_known) > KEPT:
        _known.clear()
    own = Counter(text.split())
    total = 0
    for token, n in own.items():
        code = _known.get(token)
        if code is None:
            code = _known[token] = _judged(token)
        total += n * code
    mask = (1 << _BITS) - 1
    sums = [total >> _BITS * k & mask for k in (4, 3, 2, 1, 0)]
    rows = text.split("\n")
    return sum(own.values()), *sums, len(rows), sum(x.rstrip().endswith("-") for x in rows), sum(map(text.count, _GLYPHS))


def outside(vocabulary: frozenset[str]) -> Callable[[Column], Column]:
    """Counts words, lower-cased, and those of them outside a vocabulary."""

    def one(text: str) -> tuple:
        w = _WORD.findall(text.lower())
        return len(w), len(w) - sum(map(vocabulary.__contains__, w))

    return _struct("words", "miss")(one)
