import re
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatehouse.functions import counts
from gatehouse.functions import lexicon as X
from gatehouse.functions import stats
from gatehouse.functions.text import features
from gatehouse.operators import outliers

TEXTS = [
    "", " ", "one", "no no no no no", "a\n\n\nb\n", "The cat. The cat.\nThe cat. The cat.\n- item\n", "Ã© Ñandú año � #tag... wait…", "x y\x1cz", "ALL CAPS HERE!", "m² and ½ cups 12,5",
    "word " * 50, "* bullet\n  • dot\nends...\nends … \nshort", None,
]


def expected(text):
    text = text or ""
    tokens, words, lines = re.findall(r"\S+", text), re.findall(r"[^\W\d_]+", text.lower()), text.split("\n")
    div = lambda a, b: a / b if b else 0.0
    full = [x.strip() for x in lines if x.strip()]
    pairs = Counter(zip(tokens, tokens[1:], strict=False))
    raw = text.encode()
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return {
        "char_length": len(text), "token_length": len(tokens), "mean_word_length": div(sum(map(len, words)), len(words)), "gzip_ratio": div(len(c.compress(raw) + c.flush()), len(raw)),
        "type_token_ratio": div(len(set(tokens)), len(tokens)), "bigram_repetition": div(sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)), len(tokens) - 1) if len(tokens) > 1 else 0,
        "top_ngram_fraction": div(max(pairs.values(), default=0) * 2, len(tokens)), "dup_line_fraction": div(len(full) - len(set(full)), len(full)),
        "stopword_fraction": div(sum(w in X.PROFILE_STOPWORDS for w in words), len(words)), "alpha_fraction": div(sum(x.isalpha() for x in text), len(text)),
        "punct_fraction": div(sum(not x.isalnum() and not x.isspace() for x in text), len(text)), "uppercase_fraction": div(sum(x.isupper() for x in text), sum(x.isalpha() for x in text)),
        "non_ascii_fraction": div(sum(ord(x) > 127 for x in text), len(text)), "symbol_word_ratio": div(text.count("#") + text.count("...") + text.count("…"), len(words)),
        "bullet_line_fraction": div(sum(x.lstrip()[:1] in {"-", "*", "•", "‣"} for x in lines), len(lines)), "ellipsis_line_fraction": div(sum(x.rstrip().endswith(("...", "…")) for x in lines), len(lines)),
        "short_line_fraction": div(sum(0 < len(x.strip()) < 12 for x in lines), len(lines)), "mean_line_length": sum(map(len, lines)) / len(lines),
        "mojibake_fraction": div(len(re.findall("|".join(X.MOJIBAKE_SIGNS), text)), max(1, len(words))),
    }


def test_features_equal_a_plain_count(spark):
    rows = features(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")).collect()
    for r in rows:
        for name, value in expected(TEXTS[r["doc_id"]]).items():
            assert r[name] == pytest.approx(value, abs=1e-12), (name, TEXTS[r["doc_id"]])


def test_statistics_of_nothing_and_of_few(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    cols = [stats.mean(F.col("x")), stats.median(F.col("x")), stats.std(F.col("x")), stats.quantile(F.col("x"), 0.25)]
    assert list(df.agg(*cols).first()) == pytest.approx([4.25, 3.0, 4.031128874149275, 1.75])
    assert list(df.where("x < 0").agg(*cols).first()) == [0.0] * 4
    one = spark.range(1).select(stats.ewma(F.array(F.lit(1.0), F.lit(2.0)), 0.5).alias("a"), stats.ewma(F.array().cast("array<double>"), 0.5).alias("b"), stats.sha1_short(F.lit("x")).alias("c")).first()
    assert (one["a"], one["b"], len(one["c"])) == (1.5, 0.0, 12)


def test_small_cohorts_use_pooled_statistics(spark):
    rows = [(i, "big", float(i % 5)) for i in range(13)] + [(100 + i, "small", 2.0 + i % 2) for i in range(11)] + [(200, "small", 500.0), (201, "big", 500.0)]
    df = spark.createDataFrame(rows[:-2] + rows[-2:], "doc_id int, source string, v double")
    got = {r["doc_id"]: r for r in outliers.profile(df, names=("v",)).collect()}
    assert got[200]["is_outlier"] and got[201]["outlier_flags"] == ["v"] and not got[0]["is_outlier"] and got[0]["outlier_score"] == 0.0
    fitted = outliers.fit(df.where("source = 'big'"), ("v",))
    assert outliers.score(df.where("doc_id = 200"), fitted, names=("v",)).first()["is_outlier"]  # an unseen cohort


def test_ksigma_ignores_constant_features(spark):
    df = spark.createDataFrame([(i, "s", 1.0, float(i == 50)) for i in range(51)], "doc_id int, source string, c double, v double")
    assert [r["doc_id"] for r in outliers.k_sigma(df, names=("c", "v")).where("is_outlier").collect()] == [50]


def test_ascii_words_need_no_pattern(spark, monkeypatch):
    """A search for each word of a text once took most of the time of its counts."""
    texts = ["", "The cat's 2nd hat_trick, THE\x1cend", "a b a a", *[bytes(range(128)).decode() * k for k in (1, 3)]]
    want = [(w := re.findall(r"[^\W\d_]+", t.lower()), (len(w), len("".join(w)), sum(x in X.PROFILE_STOPWORDS for x in w)))[1] for t in texts]
    monkeypatch.setattr(counts, "_WORD", None)
    assert [counts.words.counts(t)[3:] for t in texts] == want


def test_few_texts_of_a_batch_are_strings_at_once():
    """All texts of a batch were once made strings together, so a worker held a batch twice."""
    batch = pa.array([None, *["x y " * 50_000] * 300])
    tracemalloc.start()
    got = [counts.words.counts(t)[0] if len(t) < 9 else len(t) for t in counts._texts(batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [0, *[200_000] * 300] and peak < 30_000_000
