import random
import re

import numpy as np
import pytest

from gatehouse.llm import common, neardup


def brute(corpus, threshold):
    low = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("threshold", [80, 85])
def test_components_equal_brute_force(spark, docs, corpus, threshold):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, threshold=threshold).collect()}
    assert got == brute(corpus, threshold)


def test_large_nodes_branch(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF_ROWS", 4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, threshold=85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(corpus, 85).items()}


def test_odd_and_empty_tables(spark, odd):
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted([(7, 7, True), (7, 7, True), (-3, -3, True), (None, None, False), (2**40, 2**40, True), (0, 0, True)], key=str)
    assert neardup.near_duplicates(odd.where("false")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + k) for k in range(1, 300)]
    got = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame([*path, *star, (500, 500), (41, 20), (900, 800)], "a long, b long")).collect()}
    assert {got[i] for i in range(42)} == {0} and {got[100 + k] for k in range(300)} == {100} and got[900] == 800 and 500 not in got


def test_recall_and_bounded_leaves_on_some_hundred_near_pairs(spark, monkeypatch):
    """300 documents with near copies about the limit, in whole leaves and with bit rows of a few words at a time."""
    rng = random.Random(12)
    rows = []
    for k in range(300):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))]
        rows.append((2 * k, " ".join(w)))
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((2 * k + 1, " ".join(w)))
    want = brute(rows, 80)
    near = sum(c != i for i, (_, c, _) in want.items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (32 << 20, 64):
        monkeypatch.setattr(neardup, "LEAF_BYTES", width)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
        assert near > 150 and sum(got[i] == c for i, (_, c, _) in want.items() if c != i) == near and got == {i: c for i, (_, c, _) in want.items()}


def test_intersections_in_parts():
    rng = np.random.default_rng(1)
    sets = rng.random((40, 700)) < 0.3
    row, column = np.nonzero(sets)
    want = sets.astype(int) @ sets.T.astype(int)
    whole = {i: x.tolist() for i, x in neardup._intersections(row, column, 40, 700)}
    neardup_bytes, neardup.LEAF_BYTES = neardup.LEAF_BYTES, 8 * 40 * 3
    try:
        parts = {i: x.tolist() for i, x in neardup._intersections(row, column, 40, 700)}
    finally:
        neardup.LEAF_BYTES = neardup_bytes
    assert whole == parts == {i: want[i, i + 1 :].tolist() for i in range(39)}
