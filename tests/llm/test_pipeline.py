import random
import re

import pytest

import corpus_pipeline as cp
from gatehouse.llm import mixing, neardup, packing, pii, toxicity
from tests.llm.conftest import SCHEMA
from tests.llm.test_classifiers import tables
from tests.llm.test_neardup import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = tables(spark)
    rng = random.Random(1)
    rows = [tuple(r) for r in docs.collect()]
    for k in range(20):  # near copies of documents with an address added
        w = rows[6 * k + 1][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w * 2) + " x.y@z.example.com", "en", f"s{k % 2}", 0))
        rows.append((2000 + k, " ".join(w * 2) + " x.y@z.example.com end", "en", f"s{k % 2}", 0))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in cp.STAGES:
        out = stage(spark, before, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
            assert ids(after) == {r["doc_id"] for r in toxicity.score(before, model).where("not toxic").collect()} and len(ids(after)) < before.count()
        if name == "near_duplicates":
            want = brute([tuple(r) for r in before.collect()], 80)
            assert ids(after) == {i for i, (_, _, kept) in want.items() if kept} and len(ids(after)) < before.count()
        if name == "pii":
            assert ids(after) == ids(before) and not any("x.y@z" in (r["text"] or "") for r in after.collect())
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(r["text"] == (None if old[r["doc_id"]] is None else pii.replace(old[r["doc_id"]])[0]) for r in after.collect())
        if name == "mixing":
            assert sorted(map(str, after.collect())) == sorted(map(str, before.collect()))
        if name == "packing":
            assert ids(after) == ids(before)
        before = after
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(cp.run(spark, folder)) == key(before)


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0 and neardup.WORDS == 5 and re.match(r"\w+", cp.STAGES[0][0])


def test_sequences_of_run_follow_the_schedule(spark, folder, tmp_path, monkeypatch):
    """Groups of packing are contiguous ranges of the mixed order, so every prefix of groups has the schedule's source shares."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(20, 60))), "en", "x" if k % 4 else "y", 0) for k in range(1200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(cp.toxicity, "train", lambda docs, labels: None)
    monkeypatch.setattr(cp.toxicity, "filter_toxic", lambda docs, model: docs)
    monkeypatch.setattr(packing, "GROUP_DOCS", 128)
    got = cp.run(spark, str(tmp_path)).collect()
    place = {r["doc_id"]: r["position"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    source = {r[0]: r[3] for r in rows}
    groups = {}
    for r in got:
        groups.setdefault(r["sequence_id"] >> 33, set()).add(r["doc_id"])
    assert {r["doc_id"] for r in got} == set(place) and list(range(10)) == sorted(groups)
    done = 0
    for g in range(10):
        assert {place[i] for i in groups[g]} == set(range(128 * g, min(1200, 128 * (g + 1))))
        done += sum(source[i] == "y" for i in groups[g])
        if g < 6:  # before y ends: 300 to 900 documents, weights 1 to the root of 3
            assert abs(done - 128 * (g + 1) / (1 + 3**0.5)) < mixing.BLOCK
    by_seq = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sum(x["length"] for x in by_seq.setdefault(r["sequence_id"], []))
        by_seq[r["sequence_id"]].append(r)
    means = [(s >> 33, sum(place[r["doc_id"]] for r in own) / len(own)) for s, own in sorted(by_seq.items())]
    assert means == sorted(means) and all(sum(r["length"] for r in own) <= packing.CAPACITY for own in by_seq.values())


def test_packing_in_the_order_of_partitions(spark, odd):
    df = spark.range(300).selectExpr("id AS doc_id", "'a few words' AS text").repartition(7, "doc_id").sortWithinPartitions("doc_id")
    order = [r["doc_id"] for r in df.collect()]
    got = packing.pack_in_order(df, group_docs=50).collect()
    assert len(got) == 300 and all({r["doc_id"] for r in got if r["sequence_id"] >> 33 == g} == set(order[50 * g : 50 * g + 50]) for g in range(6))
    assert packing.pack_in_order(odd).count() == 6


def test_a_doc_id_with_a_copied_and_a_unique_text(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, c), (6, c), (6, d), (9, d), (8, ""), (8, None), (None, a), (3, a + " end"), (2, prose(60))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = cp.near_duplicates_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(1, a), (5, b), (6, c), (6, d), (8, ""), (8, None), (None, a), rows[-1]]))


def test_stages_pass_columns_of_any_name(spark, folder):
    """Rows without ids or texts and columns with the names that stages and operators use themselves."""
    names = ["_again", "n_replaced", "__row", "_row", "row", "_place", "__id", "__position", "__at", "position", "key", "h", "idx", "component_id", "kept", "toxic", "grade", "at", "node"]
    rows = [(1, "mail a@b.example.org now"), (1, "mail a@b.example.org now"), (None, "mail c@d.example.org"), (None, None), (4, ""), (5, "plain words " * 30)]
    df = spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA).selectExpr("*", *[f"'clash' AS `{n}`" for n in names])
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, df, folder)
        assert got.columns == df.columns, name
        assert all(r[n] == "clash" for r in got.collect() for n in names)
        assert got.count() == (5 if name == "near_duplicates" else 6), name
    assert cp.packing_stage(spark, df, folder).count() == 6
