import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import suffixes as sx
from tests.llm.conftest import prose


def test_suffix_array_lcp_and_longest_previous_factor():
    rng = random.Random(1)
    for _ in range(60):
        s = np.array([rng.choice((0, 1)) for _ in range(rng.randint(2, 30))] + [256])
        order, lcp = sx.suffix_array(s, 40)
        assert list(order) == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        same = lambda i, j: next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), len(s))
        assert list(lcp[1:]) == [same(a, b) for a, b in zip(order, order[1:], strict=False)]
        length, source = sx.longest_previous_factor(order, lcp, 1)
        assert list(length) == [max((same(i, j) for j in range(i)), default=0) for i in range(len(s))]
        assert all(n == 0 or (source[i] < i and same(i, int(source[i])) >= n) for i, n in enumerate(length))


def brute(texts, length, keep):
    raw = [(t or "").encode() for t in texts]
    seen, count = {}, Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for d, r in enumerate(raw):
        edge = np.zeros(len(r) + 1, int)
        for k in range(len(r) - length + 1):
            w = r[k : k + length]
            first = seen.setdefault(w, (d, k)) == (d, k)
            if count[w] > 1 and (keep == "none" or not first):
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        out.append((int(gone.sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("length,hot", [(400, 256), (60, 256), (60, 2), (30, 1)])
def test_removed_bytes_equal_brute_force(spark, docs, corpus, length, hot):
    got = {r["doc_id"]: r for r in sx.marked(docs, length, "none", hot=hot).mapInArrow(sx._digest(length), sx.OUT).collect()}
    want = brute([t for _, t, *_ in corpus], length, "none")
    assert len(got) == len(want)
    assert [(got[i]["n_removed"], got[i]["kept_sha256"]) for i in range(len(want))] == want


@pytest.mark.parametrize("hot", [256, 2])
def test_each_repeated_string_is_kept_once(spark, docs, corpus, hot):
    texts = {i: (t or "").encode() for i, t, *_ in corpus}
    left = Counter()
    for r in sx.marked(docs, 60, "first", hot=hot).collect():
        gone = sx._removed(texts[r["doc_id"]], r["spans"] or [], 60)
        starts = {k for s in r["spans"] or [] for k in range(s["first"], s["last"] + 1)}
        raw = texts[r["doc_id"]]
        left.update(raw[k : k + 60] for k in range(len(raw) - 59) if k not in starts)
        assert len(gone) == len(raw)
    every = Counter(t[k : k + 60] for t in set(texts.values()) for k in range(len(t) - 59))
    assert set(left) == set(every)
    copies = Counter(texts.values())  # equal ids and texts aside, a string is left where it came first
    assert all(n <= max(1, max(copies[t] for t in copies if w in t)) for w, n in left.items() if n > 1)


def test_odd_and_empty_tables(spark, odd):
    got = {r["doc_id"]: r for r in sx.marked(odd, 100, "none").mapInArrow(sx._digest(100), sx.OUT).collect()}
    assert got[7]["n_removed"] == got[7]["n_bytes"] and got[-3]["n_bytes"] == 0 and got[None]["n_removed"] == 0
    assert sx.marked(odd.where("false"), 100, "none").count() == 0


def words_brute(texts, n):
    """How many words of each text lie in a run of n words that also starts anywhere else."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[k : k + n]) for w in split for k in range(len(w) - n + 1))
    return [len({j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}) for w in split]


@pytest.mark.parametrize("words,hot", [(50, 256), (12, 256), (12, 1), (3, 2)])
def test_repeated_words_equal_brute_force(spark, corpus, words, hot):
    rng = random.Random(2)
    passage = prose(rng, 55).split()  # fewer than 400 bytes, with other white space each time
    more = ["  ".join([f"a{k}", *passage, "x" * 400]) if k % 2 else "\n".join([f"b{k}", *passage, f"c{k}\tend"]) for k in range(5)]
    texts = [t for _, t, *_ in corpus] + more + ["w " * 130, "漢 字\u2003é " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sx.marked(docs, 400, "none", hot=hot, words=words).mapInArrow(sx._digest(400, words), f"{sx.OUT}, n_repeated_words long").collect()}
    assert [got[i]["n_repeated_words"] for i in range(len(texts))] == words_brute(texts, words)
    assert [(got[i]["n_removed"], got[i]["kept_sha256"]) for i in range(len(texts))] == brute(texts, 400, "none")


def test_rows_that_repeat_and_copies_without_id_take_linear_room(spark):
    rng = random.Random(3)
    text = prose(rng, 600)
    other = prose(rng, 200) + text[500:1500] + prose(rng, 100)
    rows = [(None, text)] * 2000 + [(7, text)] * 2000 + [(8, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = sx.marked(docs, 400, "none", words=50).persist()
    spans = [n for (n,) in whole.where("doc_id is null or doc_id = 7").selectExpr("size(spans)").collect()]
    assert len(spans) == 4000 and max(spans) < 200
    got = whole.mapInArrow(sx._digest(400, 50), f"{sx.OUT}, n_repeated_words long").distinct().collect()
    assert {(r["doc_id"], r["n_removed"], r["n_bytes"]) for r in got if r["doc_id"] != 8} == {(i, len(text.encode()), len(text.encode())) for i in (None, 7)}
    shared = len(text[500:1500].encode())
    assert [shared <= r["n_removed"] < shared + 10 for r in got if r["doc_id"] == 8] == [True]


def test_texts_longer_than_a_pass(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n))
    passage = "<" + make(998) + ">"
    edge = 1 << 20
    long = make(edge - 500) + "1" + passage + "2" + make(2 * edge) + "3" + passage + "4" + "q" * (edge + 5000) + make(300)
    rows = [(1, long), (2, "5" + make(700) + "6" + passage + "7"), (3, make(2000))]
    got = {r["doc_id"]: r for r in sx.marked(spark.createDataFrame(rows, "doc_id long, text string"), 400, "none", words=50).mapInArrow(sx._digest(400, 50), f"{sx.OUT}, n_repeated_words long").collect()}
    assert got[1]["n_removed"] == 2000 + edge + 5000 and got[1]["n_spans"] == 3
    assert (got[2]["n_removed"], got[2]["n_spans"], got[3]["n_removed"]) == (1000, 1, 0)
    assert [got[i]["n_repeated_words"] for i in (1, 2, 3)] == words_brute([t for _, t in rows], 50)


def test_texts_are_shuffled_compressed(spark, docs, odd):
    rows = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    plain, packed = (sx.marked(rows, 60, "none", packed=p) for p in (False, True))
    assert packed.agg(F.sum(F.length("text"))).first()[0] < 0.7 * plain.agg(F.sum(F.octet_length("text"))).first()[0]
    got = [Counter(tuple(r) for r in m.mapInArrow(sx._digest(60), sx.OUT).collect()) for m in (plain, packed)]
    assert got[0] == got[1] and sum(got[0].values()) == rows.count()


def test_packed_texts_are_unpacked_a_pass_at_a_time():
    texts = ["a" * (1 << 19), "", "é" * 9, "b" * (3 << 20), "c"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(15), pa.int64()), pa.array(range(15), pa.int64()), pa.array(texts)], names=["doc_id", "mark", "text"])
    whole = pa.Table.from_batches(sx._pack([batch])).combine_chunks().to_batches()
    made = list(sx.unpacked(whole, 2))
    assert [x.decode() for b in made for x in b.column(2).to_pylist()] == texts and [i for b in made for i in b.column(0).to_pylist()] == list(range(15))
    assert whole[0].nbytes < 10_000 and all(len(b) == 1 or b.nbytes < sx.common.PASS_BYTES + 10_000 for b in made)
