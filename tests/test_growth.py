"""Steps whose work once grew faster than their input, or was done again for each use of it."""

import hashlib
import time

from pyspark.sql import functions as F

from gatehouse.functions import counts
from gatehouse.functions import lexicon as X
from gatehouse.operators import climb, gates, mutate, verify

TEXTS = ["", " ", "one", "a  b\nc", "Ünïcode wörds \U0001f600 and " * 40, "The quick brown fox. " * 300]


def _drawn(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def _put(parts, n, items, seed, key, what):
    """The definition: each item before its drawn place, by its counter at one place."""
    new = [(_drawn(seed, key, what + "@", k) % max(1, len(parts)), k, items[_drawn(seed, key, what, k) % len(items)]) for k in range(1, n + 1)]
    return [x for _, _, x in sorted(new + [(i, 1 << 40, x) for i, x in enumerate(parts)])]


def test_insertions_are_as_defined_and_linear(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("raw", F.lit(None).cast("string"))
    want = {
        ("html", "tag_inject"): lambda t, k: " ".join(_put(t.split(" "), max(3, len(t.split(" ")) // 25), X.INJECTED_TAGS, 3, k, "tag")),
        ("ocr", "linenoise"): lambda t, k: " ".join(_put(t.split(" "), max(8, len(t.split(" ")) // 8), X.INJECTED_GLYPHS, 3, k, "noise")),
        ("ocr", "mojibake"): lambda t, k: "".join(_put(list(t), max(6, len(t) // 80), X.MOJIBAKE, 3, k, "moji")) if t else None,
    }
    for (kind, op), made in want.items():
        for r in mutate.corrupt(docs, kind, 3, ops=(op,)).collect():
            assert made(TEXTS[r["doc_id"]], r["doc_id"]) in (r["text"], None), (op, r["doc_id"])
    long = spark.range(1).select("id", F.repeat(F.lit("some words "), 300_000).alias("text"))
    began = time.time()
    for op in (mutate.tag_inject, mutate.linenoise, mutate.mojibake):
        assert long.select(F.length(op(F.col("text"), 1, F.col("id"), "heldout")).alias("n")).first()["n"] > 3_300_000
    assert time.time() - began < 30  # fragments were once cut out by counting characters from the beginning


def test_counted_mutations_equal_counted_texts(spark):
    odd = ["<a [x](y", "see [it](http", "cut <b \n off & so &am", "ΟΔΟΣ Σ\nSign in\n\n", "[a\nb](c", "privacy policy of the http://x www.y {}", None, *TEXTS]
    docs = spark.createDataFrame([(str(k) if k else None, t) for k, t in enumerate(odd)], "doc_id string, text string").withColumn("raw", F.lit(None).cast("string"))
    slices, at = ("heldout", "train"), ("doc_id", "seed", "slice", "defect")
    plain = mutate.mutation_set(docs.fillna("", ["text"]), "html", range(6), slices).select(*at, counts.html(F.col("text")).alias("_n"))
    made = mutate.html_counted(docs, range(6), slices)
    shown = lambda df: sorted(map(str, df.select(*at, "_n.*").collect()))
    assert shown(made) == shown(plain) and made.count() == len(odd) * 24
    assert "Generate" not in made._jdf.queryExecution().toString()  # texts aren't copied for each seed and slice


def test_tallied_scores_equal_scores_and_are_shared(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 2)], "doc_id long, text string").withColumn("raw", F.lit(None).cast("string")).persist()
    pair = [gates.HTML, gates.HTML.with_params({"threshold": 0.9, "link_density": 0.0})]
    matrix, cells = verify.signals(gates.HTML, docs, "html", range(3), ("train", "heldout")), [(w, s) for w in ("train", "heldout") for s in range(3)]
    tally = verify.tallied(matrix, list(gates.HTML.weights), cells)
    shown = lambda df: sorted(map(str, df.select("candidate_id", "slice", "seed", "precision", "recall", "f1", "fpr", "n").collect()))
    assert shown(verify.score_tallied(tally, pair, cells)) == shown(verify.score(matrix, pair)) and tally.count() < matrix.count() / 3
    config, seen = climb.ClimbConfig(iterations=1, population=2), climb.measured(gates.HTML, docs, "html", docs, (0,), (1,), guard_docs=docs)
    alone = climb.hillclimb(gates.HTML, docs, "html", "verified", config, docs, (0,), (1,), guard_docs=docs).trajectory
    assert climb.hillclimb(gates.HTML, docs, "html", "verified", config, docs, (0,), (1,), guard_docs=docs, seen_before=seen).trajectory == alone


def test_the_generated_corpus_is_made_once(spark):
    from gatehouse.plans.queries import benchmark_export

    folder = "/root/testdata/sf0.001"
    got = benchmark_export(spark, folder)
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {(r["slice"], r["count"]) for r in got.groupBy("slice").count().collect()} == {(s, n) for s in ("clean", "train", "heldout")}
