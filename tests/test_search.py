import random

from pyspark.sql import functions as F

from gatehouse.functions import joins
from gatehouse.functions import lexicon as X
from gatehouse.operators import baselines, climb, gates, mutate, verify
from gatehouse.sources import adapters


def test_vocabulary_slices_are_disjoint_and_whole():
    for s, whole in zip(mutate.SLICES.values(), (X.BOILERPLATE, X.OCR_CONFUSIONS, X.RISK, X.CONTRADICTIONS), strict=True):
        assert not set(s["train"]) & set(s["heldout"]) and set(s["train"]) | set(s["heldout"]) == set(whole)
        assert len(s["heldout"]) == round(len(whole) / 4)


def test_gates_pass_clean_documents_and_catch_mutations(spark):
    docs = adapters.clean_corpus(spark, 90, 7).persist()
    for name in ("html", "ocr", "json"):
        gate, own = gates.GATES[name], docs.where(F.col("modality") == name)
        s = verify.score(verify.signals(gate, own, name, (0,)), [gate]).first()
        assert s["fpr"] <= 0.1 and s["recall"] >= 0.6 and s["n"] == 60, (name, s)
    docs.unpersist()


def test_mutations_depend_on_the_document_alone(spark):
    docs = adapters.clean_corpus(spark, 12, 3, ("html",))
    key = lambda df: {r["doc_id"]: (r["operator"], r["text"]) for r in df.collect()}
    assert key(mutate.corrupt(docs, "html", 5)) == key(mutate.corrupt(docs.repartition(7), "html", 5))
    assert key(mutate.corrupt(docs, "html", 5)) != key(mutate.corrupt(docs, "html", 6))


def test_schema_break_and_charsub(spark):
    docs = adapters.clean_corpus(spark, 9, 7)
    broken = mutate.corrupt(docs.where("modality = 'json'"), "json", 1, ops=("schema_break",)).collect()
    assert all(r["raw"] for r in broken)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = mutate.corrupt(docs, "ocr", 1, ops=("charsub",)).collect()
    assert all(r["text"] != before[r["doc_id"]] for r in after)


def test_accept_rule_needs_both_gain_and_guard(spark):
    rows = [(c, "heldout", s, 0.5 + 0.2 * (c > 0) + 0.001 * s, 0.1 * (c == 2)) for c in (0, 1, 2) for s in range(5)]
    scores = spark.createDataFrame(rows, "candidate_id int, slice string, seed int, f1 double, fpr double")
    assert verify.accepted(scores, 0, 1).reason == "ok" and verify.accepted(scores, 0, 2).reason == "FPR regression"
    assert verify.accepted(scores, 0, 0).reason == "gain not significant" and verify.t_multiplier(5) == 2.776 and verify.t_multiplier(99) == 1.96


def test_proposers():
    a, b = (climb.OfflineProposer(7, 0.1).propose_many(gates.HTML, 3) for _ in range(2))
    assert a == b and all(g.bounds()[k][0] <= v <= g.bounds()[k][1] for g in a for k, v in g.params().items())
    said = climb.AgenticProposer(lambda p: 'try {"markup_leak": 99, "threshold": 0.4}').propose(gates.HTML)
    assert said.weights["markup_leak"] == 5.0 and said.threshold == 0.4
    assert climb.AgenticProposer(lambda p: 1 / 0).propose(gates.HTML) != gates.HTML
    assert climb.perturbed(gates.HTML, random.Random(1), 0.1, 1) != gates.HTML


def test_naive_recall_climb_does_not_lose_recall(spark):
    docs = adapters.clean_corpus(spark, 20, 7, ("html",))
    start = gates.HTML.with_params({k: w / 4 for k, w in gates.HTML.weights.items()})
    got = climb.hillclimb(start, docs, "html", "naive_recall", climb.ClimbConfig(iterations=1, population=2), None, (0,), ops=("link_dump", "script_style"))
    assert len(got.trajectory) == 2 and got.trajectory[1]["recall_train"] >= got.trajectory[0]["recall_train"]


def test_baselines(spark):
    docs = spark.createDataFrame([("a", "alpha beta beta"), ("b", "gamma delta"), ("c", "")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in baselines.oov(docs, baselines.vocabulary(docs.where("doc_id = 'a'"))).collect()}
    assert got["a"]["oov_share"] == 0 and got["b"]["s_oov"] == 1.0 and got["c"]["n_words"] == 0
    assert baselines.gzip_signal(docs, baselines.fit_gzip(docs)).count() == 3


def test_a_large_vocabulary_gives_the_same(spark, monkeypatch):
    texts = [("a", "the cat and the dog"), ("b", "unknown words HERE the the the"), ("c", None), ("d", ""), ("d", "the cat"), (None, "dog " * 50)] + [(f"e{k}", "the cat sat") for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id string, text string").repartition(3)
    vocab = spark.createDataFrame([(w,) for w in ("the", "cat", "sat", "and")], "word string")
    shown = lambda df: sorted(map(str, df.select("doc_id", *[c for c in df.columns if c != "doc_id"]).collect()))
    want, gate = shown(baselines.oov(docs, vocab)), shown(baselines.oov_gate(vocab).evaluate(docs))
    assert "n_words=5, oov_share=0.2" in want[0]
    for hot in (1, 20, 10**9):
        monkeypatch.setattr(joins, "HOT", hot)
        monkeypatch.setattr(baselines, "HANDED_WORDS", 2)
        assert shown(baselines.oov(docs, vocab)) == want and shown(baselines.oov_gate(vocab).evaluate(docs)) == gate
