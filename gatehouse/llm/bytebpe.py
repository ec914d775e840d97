"""Byte-level BPE ids of many texts at once.

Pre-tokens are found in numpy on the code points of a batch: runs of letters, of numbers, of other marks (each with one
space before it), contractions, and white space. A pre-token's ids don't depend on its neighbours, so each distinct one is
encoded once by the tokenizer library and kept in sorted arrays of its 64-bit hash; the batch's ids are then gathered.
Added tokens of the tokenizer's file, such as its end of text, part a text as its own ends do and have their own id, or are plain text.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

from gatehouse.llm import common

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct pre-tokens that a worker keeps; beyond that the table starts anew, which changes only speed.
KEPT = 1_000_000
#: Fixed values of the tokenizer's pattern: what may follow an apostrophe as a contraction.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
#: Code points that count as white space in the pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k is not None:
            out[c] = k
    out[WHITE] = SPACE
    return out


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: visible ones for themselves, the others from U+0100 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            added = [] if plain else sorted((x["content"] for x in json.load(f)["added_tokens"]), key=len, reverse=True)
        self._added, self._any_added = tuple(added), re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self._class = _classes()
        self._powers = common.Powers()
        self._forget()

    def _forget(self) -> None:
        self._hash = np.zeros(0, np.uint64)
        self._at = np.zeros(1, np.int64)  # offsets into _ids by the order of _hash's entries as they came
        self._slot = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def cuts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin. starts: where non-empty texts begin, 0 first."""
        n = len(codes)
        kind = self._class[codes]
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first[n] = True
        edge = first.copy()
        edge[1:n] |= kind[1:] != kind[:-1]  # runs of one class
        cut = edge.copy()
        runs = np.flatnonzero(edge)
        begin, end = runs[:-1], runs[1:]
        white = kind[begin] == SPACE
        inner = white & ~first[end]  # white space that something follows in its text
        last = end[inner] - 1
        plain = codes[last] == 32
        # the last white character: a space joins what follows, any other is a token of its own
        cut[last] = True
        cut[end[inner][plain]] = False
        quote = begin[(kind[begin] == OTHER) & (end - begin == 1) & (codes[begin] == 39)]
        quote = quote[cut[quote] & ~first[quote + 1]]
        if len(quote):
            padded = np.concatenate([codes, [0, 0, 0]])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, [ord(c) for c in CONTRACTIONS if len(c) == 1])
            two = np.zeros(len(quote), bool)
            for c in CONTRACTIONS:
                if len(c) == 2:
                    two |= (a == ord(c[0])) & (b == ord(c[1])) & ~first[np.minimum(quote + 2, n)]
            for hit, size in ((one, 2), (two & ~one, 3)):
                at = quote[hit]
                cut[at + 1] = False
                cut[np.minimum(at + size, n)] = True
        return np.flatnonzero(cut)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as one uint32 array, and the n + 1 offsets."""
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[sizes > 0]
        controls = self._controls(texts, ends - sizes) if any(x in whole for x in self._added) else np.zeros((0, 2), np.int64)
        if len(controls):
            starts = np.unique(np.concatenate([starts, controls[:, 0], controls[:, 1][controls[:, 1] < len(codes)]]))
        cut = self.cuts(codes, starts)
        if len(controls):  # a control string is one pre-token
            inside = np.searchsorted(controls[:, 0], cut, side="left") - 1
            cut = cut[(inside < 0) | (cut >= controls[np.maximum(inside, 0), 1])]
        up, down = self._powers.reach(len(codes) + 1)
        prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
        at = prefix[cut]
        lengths = np.diff(cut)
        key = common.mix64((at[1:] - at[:-1]) * down[cut[:-1]] + lengths.astype(np.uint64))
        distinct, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        slots = self._find(distinct, where, whole, cut)
        counts = (self._at[1:] - self._at[:-1])[slots][inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        out = self._ids[np.arange(total[-1]) + np.repeat(self._at[slots][inverse] - total[:-1], counts)]
        return out, total[np.searchsorted(cut, np.concatenate([[0], ends]))]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        byte = {c: b for b, c in enumerate(_byte_letters())}
        tokens = [self._tokenizer.id_to_token(i) or "" for i in range(self._tokenizer.get_vocab_size())]
        return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]

    def _controls(self, texts: list[str], starts: np.ndarray) -> np.ndarray:
        """Where added tokens begin and end in the joined texts, in order."""
        found = [(a + m.start(), a + m.end()) for t, a in zip(texts, starts.tolist(), strict=True) for m in self._any_added.finditer(t)]
        return np.array(found, np.int64).reshape(-1, 2)

    def _find(self, keys: np.ndarray, where: np.ndarray, whole: str, cut: np.ndarray) -> np.ndarray:
        """Slots of sorted distinct keys; those not known are encoded and kept."""
        if len(self._hash) > KEPT:
            self._forget()
        pos = np.searchsorted(self._hash, keys)
        known = pos < len(self._hash)
        known[known] = self._hash[pos[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            at = where[new]
            got = [x.ids for x in self._tokenizer.encode_batch_fast([whole[a:b] for a, b in zip(cut[at].tolist(), cut[at + 1].tolist(), strict=True)], add_special_tokens=False)]
            sizes = np.array([len(g) for g in got], np.int64)
            first = len(self._at) - 1
            self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(sizes)])
            self._ids = np.concatenate([self._ids, np.array([i for g in got for i in g], np.uint32)])
            into = pos[new]
            self._hash = np.insert(self._hash, into, keys[new])
            self._slot = np.insert(self._slot, into, np.arange(first, first + len(new)))
            pos = np.searchsorted(self._hash, keys)
        return self._slot[pos]


@lru_cache(maxsize=2)
def byte_bpe(path: str, plain: bool = False) -> ByteBpe:
    """One for each worker, whose table later tasks use."""
    return ByteBpe(path, plain)
