import hashlib
import random

import pytest

from gatehouse.llm import fingerprints as fp
from tests.llm.conftest import prose


def test_spans_and_extensions():
    a, b = fp.PrefixHash(fp.codes("xxabcdefgh")), fp.PrefixHash(fp.codes("abcdefzz"))
    assert a.lce(2, b, 0) == 6 and a.lce(0, b, 0) == 0 and a.equal(2, b, 0, 6) and not a.equal(2, b, 0, 7)
    assert a.lce(2, a, 2) == 8 and b.lce(8, b, 0) == 0
    assert (a.spans(4)[2:5] == b.spans(4)[:3]).all()
    whole, head = fp.PrefixHash(fp.codes("hello world")), fp.PrefixHash(fp.codes("hello there"))
    assert fp.PrefixHash(fp.codes("world"), head, 6).span(0, 11) == whole.span(0, 11)


def test_every_document_against_its_edited_text_and_the_next(spark, docs, corpus):
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(docs).collect()}
    texts = [t or "" for _, t, *_ in corpus]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_next"] == fp.likeness(got[i]["fingerprint"], got[(i + 1) % len(texts)]["fingerprint"])
        assert got[i]["near_edited"] == fp.likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"]) and 0 <= got[i]["near_edited"] <= 1
        assert got[i]["common_prefix_next"] == next((k for k, (a, b) in enumerate(zip(t, following, strict=False)) if a != b), min(len(t), len(following)))
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)


@pytest.mark.parametrize("n", [1, 3, 64])
def test_buckets_do_not_matter(spark, docs, n):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(fp.fingerprint_documents(docs, n)) == key(fp.fingerprint_documents(docs))


def test_odd_and_empty_tables(spark, odd):
    got = fp.fingerprint_documents(odd)
    assert got.count() == 6 and fp.fingerprint_documents(odd.where("false")).count() == 0
    one = fp.fingerprint_documents(odd.where("doc_id = 0")).collect()  # the next document is itself
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_likeness_is_near_the_true_jaccard_share(spark):
    """Against the sets of all 16-character spans, within four standard deviations of a 64-value sketch."""
    rng = random.Random(8)
    base = prose(rng, 400)
    texts = [base]
    for part in (0.05, 0.2, 0.4, 0.6, 0.9):
        cut = int(len(base) * part)
        texts.append(prose(rng, 400)[:cut] + base[cut:])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint_documents(df).collect()}
    spans = [{t[k : k + 16] for k in range(len(t) - 15)} for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            true = len(spans[i] & spans[j]) / len(spans[i] | spans[j])
            assert abs(fp.likeness(prints[i], prints[j]) - true) <= 4 * (max(true * (1 - true), 0.01) / 64) ** 0.5 + 0.02
