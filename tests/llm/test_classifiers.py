import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatehouse.llm import quality, toxicity
from tests.llm.conftest import SCHEMA, prose


def tables(spark, toxic_words=("scumlike", "idiotes")):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, rng.randint(30, 120)).split()
        toxic, junk = i % 6 == 0, i % 5 == 1
        if toxic:
            for _ in range(rng.randint(2, 5)):
                t.insert(rng.randrange(len(t)), rng.choice(toxic_words))
        t = [w.upper() + "!!" for w in t] if junk else t
        rows.append((i, " ".join(t), "en", "s", 1))
        if i % 4 != 3:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(400, "", "en", "s", 0), (401, None, "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 402
    truth = {i: i % 6 == 0 for i in range(400)}
    assert sum(got[i]["toxic"] != v for i, v in truth.items()) <= 8
    assert not got[400]["toxic"] and not got[401]["toxic"] and all(0 <= r["expected_severity"] <= 2 for r in got.values())
    mean = lambda v: np.mean([got[i]["expected_severity"] for i in truth if truth[i] == v])
    assert mean(True) > 1 > 0.2 > mean(False)
    kept = toxicity.filter_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}
    assert list(model.thresholds) == sorted(model.thresholds)


def test_without_labels_nothing_is_toxic_and_scores_are_even(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, none)
    assert toxicity.filter_toxic(odd, model).count() == 6 and toxicity.score(odd.where("false"), model).count() == 0
    assert toxicity.filter_toxic(odd, model).columns == odd.columns
    net = quality.train(odd, none)
    assert net is None and {r["score"] for r in quality.score(odd, net).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in got if got[i]["held_out"]} == {i for i in range(402) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([got[i]["predicted"] == int(i % 5 != 1) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = tables(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted(map(tuple, quality.score(docs, quality.train(docs, x)).collect())) for x in (labels, turned))
    assert a == b


def test_likelihood_and_gradient_against_brute_force():
    """-log P(grade) written out, and differences of it, for two and three grades."""
    rng = np.random.default_rng(2)
    for grades in (2, 3):
        s, theta, gap = rng.normal(size=9), 0.3, -0.4
        grade = rng.integers(0, grades, 9)

        def plain(s, theta, gap):
            at = lambda v: 1 / (1 + np.exp(-v))
            total = 0.0
            for x, g in zip(s, grade, strict=True):
                above = [1.0, at(x - theta), at(x - theta - np.exp(gap)) if grades == 3 else 0.0, 0.0]
                total -= np.log(above[g] - above[g + 1])
            return total / len(s)

        value, ds, dtheta, dgap = toxicity.loss(s, theta, gap, grade, grades)
        assert abs(value - plain(s, theta, gap)) < 1e-12
        e = 1e-6
        for k in range(9):
            up, down = s.copy(), s.copy()
            up[k] += e
            down[k] -= e
            assert abs(ds[k] - (plain(up, theta, gap) - plain(down, theta, gap)) / (2 * e)) < 1e-7
        assert abs(dtheta - (plain(s, theta + e, gap) - plain(s, theta - e, gap)) / (2 * e)) < 1e-7
        assert abs(dgap - (plain(s, theta, gap + e) - plain(s, theta, gap - e)) / (2 * e)) < 1e-7


def test_scores_equal_a_plain_sum(spark):
    """Weights, levels and thresholds of the fitted model applied word by word."""
    docs, labels = tables(spark)
    m = toxicity.train(docs, labels)
    key = lambda w: toxicity.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]
    where = {int(k): i for i, k in enumerate(m.keys)}
    got = {r["doc_id"]: r for r in toxicity.score(docs, m).collect()}
    for i, text, *_ in docs.limit(60).collect():
        raw = "".join(c.lower() if c.isascii() else c for c in text).encode()
        own = re.findall(rb"[a-z\x80-\xff]+", raw)
        counts = {}
        for w in own:
            for h in {("w", w), *(((k, w[:k])) for k in (5, 7) if len(w) > k)}:
                counts[h] = counts.get(h, 0) + 1
        total = 0.0
        for (kind, w), n in counts.items():
            h = int(key(w)) if kind == "w" else int(toxicity.words(np.frombuffer(w + b"z", np.uint8), np.array([0, len(w) + 1]), (kind,))[0][1])
            if h in where:
                total += sum(m.weights[where[h], k] for k, (least, of) in enumerate(toxicity.LEVELS) if n >= least and n * of >= len(own) * (of > 0))
        want = [1 / (1 + np.exp(t - total)) for t in m.thresholds]
        assert abs(got[i]["expected_severity"] - sum(want)) < 1e-9 and abs(got[i]["p_toxic"] - want[0]) < 1e-9


def test_severity_is_held_out_and_ordered(spark):
    """More toxic words make a higher grade, though no label says so."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        t = prose(rng, 80).split()
        for _ in range([0, 0, 1, 9][i % 4]):
            t.insert(rng.randrange(len(t)), rng.choice(("scumlike", "idiotes")))
        rows.append((i, " ".join(t), "en", "s", 1))
        labels.append((i, 1, int(i % 4 > 1)))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["expected_severity"] for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    mean = [np.mean([got[i] for i in range(600) if i % 4 == k]) for k in (0, 2, 3)]
    assert mean[0] < 0.3 < mean[1] < mean[2]


def test_risk_and_gradient_against_brute_force():
    rng = np.random.default_rng(3)
    gp, gu = rng.normal(size=5), rng.normal(size=7)
    for prior, shift in ((0.4, 0.0), (0.9, -6.0)):  # the second has a negative part below 0
        u = gu + shift

        def parts(p, v, prior=prior):
            l = lambda z: np.log1p(np.exp(-z))  # noqa: E731, E741
            return prior * np.mean([l(x) for x in p]), np.mean([l(-x) for x in v]) - prior * np.mean([l(-x) for x in p])

        positive, negative, d = quality.pu_risk(gp, u, prior)
        assert np.allclose((positive, negative), parts(gp, u)) and (negative < 0) == (shift < 0)
        whole = (lambda p, v: sum(parts(p, v))) if negative >= 0 else (lambda p, v: -parts(p, v)[1])
        e = 1e-6
        for k in range(12):
            z = np.concatenate([gp, u])
            up, down = z.copy(), z.copy()
            up[k] += e
            down[k] -= e
            assert abs(d[k] - (whole(up[:5], up[5:]) - whole(down[:5], down[5:])) / (2 * e)) < 1e-7


def test_the_prior_is_found_without_negatives():
    rng = np.random.default_rng(5)
    for prior in (0.3, 0.6, 0.85):
        n = 6000
        p = rng.normal(0, 1, (n, 6))
        u = np.where((rng.random(n) < prior)[:, None], rng.normal(0, 1, (n, 6)), rng.normal(0, 1, (n, 6)) + 2.0)
        assert abs(quality.estimated_prior(p, u) - prior) < 0.07


def test_long_texts_repeated_ids_and_clashing_columns(spark):
    docs, labels = tables(spark)
    again = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 0")).withColumns({"toxic": F.lit("clash"), "grade": F.lit("clash"), "score": F.lit("clash")})
    long = spark.createDataFrame([(9000, "plain words of prose " * 100_000, "en", "s", 1)], SCHEMA).withColumns({c: F.lit("clash") for c in ("toxic", "grade", "score")})
    df = again.unionByName(long)
    model = toxicity.train(df, labels)
    one = toxicity.train(docs, labels)
    assert np.array_equal(model.keys, one.keys) and np.allclose(model.weights, one.weights)
    assert toxicity.score(df, model).count() == 405 and toxicity.filter_toxic(df, model).columns == df.columns
    net = quality.train(df, labels)
    assert quality.score(df, net).count() == 405


def test_words_are_counted_whole_when_fitted():
    text = "vile " * 1000 + "calm " * 300 + "once"
    (bag,) = toxicity._bags([pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([text]), pa.array(["7"])], names=["y", "text", "doc_id"])])
    counts = np.frombuffer(bag.column(3)[0].as_py(), np.uint32)
    assert sorted(counts.tolist())[-1] == 1000 and 300 in counts and bag.column(4)[0].as_py() == 1301
