"""Simple detectors that gates are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.checkpoints import cut
from gatehouse.functions import counts
from gatehouse.functions import lexicon as X
from gatehouse.functions.joins import counted_join
from gatehouse.functions.stats import robust_z
from gatehouse.functions.text import clamp, gzip_ratio, occurrences, share
from gatehouse.operators import outliers
from gatehouse.operators.gates import Gate, parses


def fit_gzip(clean: DataFrame) -> DataFrame:
    """One row: median and MAD of the compression ratio of clean texts (0.4 and 0.05 of none)."""
    one = outliers.fit(clean.select(F.lit("").alias("source"), gzip_ratio("text").alias("r")), ("r",)).where("pooled")
    return one.agg(F.coalesce(F.max("med"), F.lit(0.4)).alias("med"), F.coalesce(F.max("mad"), F.lit(0.05)).alias("mad"))


def gzip_signal(docs: DataFrame, fitted: DataFrame) -> DataFrame:
    """doc_id, gzip_ratio and its defect signal."""
    rows = docs.select("doc_id", gzip_ratio("text").alias("gzip_ratio")).crossJoin(F.broadcast(fitted))  # one row
    return rows.select("doc_id", "gzip_ratio", clamp(F.abs(robust_z(F.col("gzip_ratio"), F.col("med"), F.col("mad"))) / 4).alias("s_gzip"))


def _gopher(_: Gate):
    t, n = F.col("text"), F.col("_n")
    symbols = share(occurrences(t, "#") + occurrences(t, "...") + occurrences(t, "…"), n["words"])
    links = occurrences(F.lower(t), "http") / F.greatest(n["tokens"], F.lit(1))
    return {"stopword_deficit": F.lit(1.0) - F.least(F.lit(1.0), share(n["stop"], n["words"]) / 0.15), "symbols": 1.5 * symbols + 4 * links}


GOPHER = Gate("gopher", {"stopword_deficit": 1.0, "symbols": 1.0}, _gopher, counts=counts.words)
PARSE_ONLY = Gate("json", {"parse_fail": 1.0}, lambda _: {"parse_fail": F.when(parses(), 0.0).otherwise(1.0)}, reads="raw")


def vocabulary(clean: DataFrame) -> DataFrame:
    """Distinct lower-cased words of clean texts."""
    return clean.select(F.explode(F.array_distinct(_words())).alias("word")).distinct()


def _words():
    return F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))


#: A vocabulary of so many words is handed to every task; a larger one is joined.
HANDED_WORDS = 500_000


def missed(docs: DataFrame, vocab: DataFrame, handed: int | None = None) -> DataFrame:
    """docs with the struct _n: words of the text, and miss, how many of them are outside the vocabulary.

    A vocabulary beyond `handed` words is joined to the distinct words of docs, and these, each with its number of occurrences, to the
    occurrences: frequent words by broadcast, the others by a shuffle in which no word has many rows. Both ways give the same.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    handed = HANDED_WORDS if handed is None else handed
    if vocab.limit(handed + 1).count() <= handed:
        known = frozenset(r["word"] for r in vocab.collect())  # of a checked size
        return docs.withColumn("_n", counts.outside(known)(F.col("text")))
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    words = rows.select("_row", F.explode(_words()).alias("word"))
    own = words.groupBy("word").agg(F.count(F.lit(1)).alias("_k"))
    judged = cut(own.join(vocab.select("word", F.lit(0).alias("_known")).distinct(), "word", "left").select("word", "_k", F.coalesce("_known", F.lit(1)).alias("_miss")))
    sums = counted_join(words, judged, "word", "_k").groupBy("_row").agg(F.count(F.lit(1)).alias("words"), F.sum("_miss").alias("miss"))
    none = F.lit(0).cast("long")
    return rows.join(sums, "_row", "left").withColumn("_n", F.struct(F.coalesce("words", none).alias("words"), F.coalesce("miss", none).alias("miss"))).drop("_row", "words", "miss")


def oov(docs: DataFrame, vocab: DataFrame, handed: int | None = None) -> DataFrame:
    """doc_id, n_words, oov_share and the defect signal, for every row and a vocabulary of any size."""
    part = share(F.col("_n.miss"), F.col("_n.words"))
    return missed(docs.select("doc_id", "text"), vocab, handed).select("doc_id", F.col("_n.words").cast("long").alias("n_words"), part.alias("oov_share"), clamp(2 * part).alias("s_oov"))


def gzip_gate(fitted: DataFrame) -> Gate:
    """The compression ratio as a gate; fitted: one row of fit_gzip()."""
    r = fitted.first()
    return Gate("gzip", {"anomaly": 1.0}, lambda _: {"anomaly": F.abs(robust_z(gzip_ratio(F.col("text")), F.lit(r["med"]), F.lit(r["mad"]))) / 4}, counts=None)


def oov_gate(vocab: DataFrame, handed: int | None = None) -> Gate:
    """Words outside a vocabulary of any size as a gate, weight 2; see missed()."""
    return Gate("dictionary", {"oov": 2.0}, lambda _: {"oov": 2 * share(F.col("_n")["miss"], F.col("_n")["words"])}, joined=lambda df: missed(df, vocab, handed))


def fitted_baselines(kind: str, clean: DataFrame) -> dict[str, Gate]:
    """The baseline detectors of a modality by name, fitted on the texts of clean documents."""
    common = {"gzip": gzip_gate(fit_gzip(clean))}
    if kind == "html":
        return {**common, "gopher": GOPHER}
    if kind == "ocr":
        return {**common, "ocr_dict": oov_gate(vocabulary(clean))}
    return {**common, "parse_only": PARSE_ONLY}
