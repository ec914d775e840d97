from pathlib import Path

import numpy as np
import pytest

from gatehouse.llm import vectors


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(240):
        v = rng.normal(size=8)
        rows += [(len(rows) + j, [float(x) for x in (v + j * rng.normal(size=8) * 0.05) * (1 + j)], k % 3) for j in range(1 + k % 3)]
    rows += [(len(rows) + j, rows[0][1], 0) for j in range(20)]
    bad = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None], [float("inf")] + [1.0] * 7, [1.0, 2.0]]
    rows += [(5000 + j, v, 0) for j, v in enumerate(bad)] + [(6000, rows[0][1], None), (6001, rows[0][1], 7)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS key", "'clash' AS rep"), rows


@pytest.mark.parametrize("cell", [16, 10**6])
def test_links_and_components_equal_brute_force(spark, table, cell, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", cell)
    df, rows = table
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v) and l is not None]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([l for _, _, l in good])
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    ids = np.array([i for i, _, _ in good])
    comp = ids.copy()
    for _ in range(60):
        comp = np.minimum(comp, np.where(link, comp[None, :], 1 << 60).min(axis=1))
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp, strict=True)}
    assert len(got) == len(rows) and all(got[i] == want.get(i, (0, i, True)) for i, *_ in rows)


def test_empty_table(spark, table):
    assert vectors.near_vectors(table[0].where("false")).count() == 0


def test_registered_size_with_links_and_large_cells(spark):
    """Clusters around and below the limit, some dense beyond a block, some copies; cells whole and dealt to blocks."""
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for k in range(60):
        centre = rng.normal(size=32)
        for _ in range(int(rng.integers(2, 40)) if k else 500):
            v = centre + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.14])
            rows.append((n, v.astype(np.float32).tolist(), int(k % 3)))
            n += 1
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(0, 200, 7)]
    rows += [(2 * n + i, rng.normal(size=32).astype(np.float32).tolist(), 1) for i in range(1500)]
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label)
    equal = (x[:, None, :4] == x[None, :, :4]).all(axis=2) & (label[:, None] == label)
    linked |= equal
    np.fill_diagonal(linked, False)
    comp = np.arange(len(rows))
    while True:
        low = np.array([min(comp[i], comp[linked[i]].min(initial=comp[i])) for i in range(len(rows))])
        if (low == comp).all():
            break
        comp = low
    want = {rows[i][0]: (int(linked[i].sum()), rows[comp[i]][0]) for i in range(len(rows))}
    assert linked.sum() > 10_000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (8192, 64):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df, block=block).collect()}
        assert got == want, block


def test_disk_does_not_grow_with_cells(spark, monkeypatch):
    """Unrelated vectors, near to most cells, with some clusters and copies: blocks are compared in pairs, but no vector is written more than a few times."""
    monkeypatch.setattr(vectors, "CELL", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x[:900] = x[np.arange(900) % 3] + rng.normal(size=(900, 64)) * rng.choice([0.05, 0.13, 0.15], 900)[:, None]
    x[:, 0] *= rng.random(6000) < 0.9  # zeros of both signs
    x = x.astype(np.float32)
    x[1000:1100], x[1100:1140] = x[900], x[0]
    ids = rng.permutation(6000)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    order = np.argsort(ids)
    linked = (unit[order] @ unit[order].T >= 0.98) & (order < 5950)[:, None] & (order < 5950)  # the last ones are alone under their label
    np.fill_diagonal(linked, False)
    comp = np.arange(6000)
    for i in range(6000):
        if comp[i] == i:
            todo = [i]
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & (comp > i))
                comp[new] = i
                todo += new.tolist()
    want = {i: (int(linked[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(6000)}
    assert linked.sum() > 50_000
    df = spark.createDataFrame([(int(i), v.tolist(), 0 if k < 5950 else k) for k, (i, v) in enumerate(zip(ids, x, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4).persist()
    assert df.count() == 6000
    sc = spark.sparkContext._jsc.sc()
    vectors.common.ensure_checkpoint_dir(spark)
    folder = Path(sc.getCheckpointDir().get().removeprefix("file:"))

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite() + sum(f.stat().st_size for f in folder.rglob("part-*"))

    before = written()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df, block=512).collect()}
    assert got == want
    assert written() - before < 4 * x.nbytes
