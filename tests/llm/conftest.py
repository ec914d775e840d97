import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    words = ["anea", "tion", "erha", "wordly", "éçau", "the", "of", "reou", "that", "shble", "inor", "hest", "Ndti.", "ou"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Prose with exact and near copies, a shared passage, repeats within a text, a long text, short and empty ones, and nulls."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(20, 160)) for _ in range(60)]
    passage = prose(rng, 90)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 25) for _ in range(6)]
    for k in range(8):  # near copies with one to eight words changed
        w = texts[3].split() * 2
        for _ in range(k + 1):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [texts[1].upper()] + ["Thhaen " * 120, prose(rng, 9000), "", None, "one", "one two", "a b c d e", None, "   \n"]
    return [(i, t, "en", f"src{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, ids without order, a null id, a null source, and extra columns whose names operators use themselves."""
    extra = ["fingerprint", "bucket", "key", "position", "block", "mark", "spans", "n_replaced", "component_id", "kept", "score", "y", "sequence_id", "sig", "rep", "node", "_again", "label"]
    rows = [(7, "same text here " * 40, "en", None, 1), (7, "same text here " * 40, "en", None, 1), (-3, "", None, "s", None), (None, "a text without an id " * 3, "en", "s", 2), (2**40, None, None, None, None), (0, "x", "en", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df
