import hashlib
from collections import Counter
from itertools import product

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(tokenizers, texts):
    """Counts and digests of texts, with every link spelled out."""
    a_side, b_side = tokenizers
    letters = alignment.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), True).token_bytes()
    made, held = [], Counter()
    for text in texts:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [letters[i] for i in a]
        b_bytes = [bytes([int(p[3:-1], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            made.append(([], [], []))
            continue
        groups, now, x, y = [], ([], []), 0, 0
        i = j = 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a) and not (x == y and now[0]):
                now[0].append(a[i])
                x += len(a_bytes[i])
                i += 1
            else:
                now[1].append(b[j])
                y += len(b_bytes[j])
                j += 1
            if x == y and now[0] and now[1]:
                groups.append(now)
                now = ([], [])
        made.append((a, b, groups))
        held.update({p for g in groups for p in product(*g)})
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for a, b, groups in made:
        links = [p for g in groups for p in product(*g)]
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return out


HARD = [
    "", None, " ", "a", "  two  spaces ", "tab\tand\nlines\n\n", "abab" * 50, "x" * 300, "▁ under", "<|endoftext|> and </s> <s>", "ﬁ ｆ ² naïve café", "漢字かな😀😀 mixed 漢字", "\u00a0no break\u2003wide", "don't we'll I'd", "12345 3.14 -- !!??",
    "café déjà", "\x00 nul", "a\u0301 combining",
]


def test_equals_every_link_spelled_out(spark, tokenizers, corpus, odd):
    texts = [t for _, t, *_ in corpus] + HARD + HARD[:6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in alignment.align(df).collect()}
    want = plain(tokenizers, texts)
    assert len(got) == len(texts)
    for i, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert got[i] == w, (i, t)
    assert got[texts.index("▁ under")][:4] == (0, 0, 0, 0) and sum(w[0] > w[2] for w in want) > 10
    rows = odd.select("doc_id", "text").collect()
    got = Counter((r["doc_id"], *(r[c] for c in cols)) for r in alignment.align(odd).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, plain(tokenizers, [r[1] for r in rows]), strict=True))
    assert alignment.align(df.where("false")).count() == 0


def test_hot_and_rare_pairs_give_the_same(spark, tokenizers, monkeypatch):
    texts = ["the cat sat on the mat " * (1 + k % 3) for k in range(40)] + ["rarely said words herein"] * 2 + HARD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(plain(tokenizers, texts))
    for hot in (1, 20, 10**9):  # all by shuffle, both ways, all by broadcast
        monkeypatch.setattr(alignment.common, "HOT", hot)
        assert sorted(tuple(r)[1:] for r in alignment.align(df).collect()) == want


def test_parts_of_long_texts(spark, tokenizers, monkeypatch):
    text = "Some words in a row, then 12 more; " * 300 + "漢字" * 40 + " and the end"
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    parts = alignment.parts_of(text, 50)
    assert "".join(parts) == " " + text and len(parts) > 100
    sides = alignment._sides(*alignment.paths())
    for side in sides:
        ids = [side[0](x)[0].tolist() for x in (parts, [" " + text])]
        assert ids[0] == ids[1]


def test_a_group_of_many_tokens_makes_few_links(spark):
    n = 20_000  # both sides share only the last end
    row = spark.createDataFrame([(1, [7] * n, [*range(2, 2 * n, 2), 2 * n], [9] * n, [*range(1, 2 * n - 1, 2), 2 * n])], alignment.TOKENS)
    got = alignment.aligned(row).select("n_links", "n_groups", F.size("ones"), F.size("more"), F.expr("more[0].m")).first()
    assert tuple(got) == (n * n, 1, 0, 1, n * n)
    assert [len(x) for x in alignment.grouped(row).first()["groups"][0]] == [n, n]
