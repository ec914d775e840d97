"""Inputs as documents (doc_id, text, source, modality, raw), JSON lines, and a generated clean corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gatehouse.functions import lexicon as X

MODALITIES = ("html", "ocr", "json", "text")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions: a shuffle of a small table, against rows that are costly to compute."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modality(x: Column) -> Column:
    """Unknown modalities are plain text."""
    return F.when(x.isin(*MODALITIES), x).otherwise("text")


def as_documents(df: DataFrame, doc_id: Column, text: Column, source: Column, kind: Column, raw: Column | None = None) -> DataFrame:
    return df.select(doc_id.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(source, F.lit("unknown")).alias("source"), modality(kind).alias("modality"), (F.lit(None).cast("string") if raw is None else raw).alias("raw"))


def documents(spark: SparkSession, sf_dir: str, kind: str = "text") -> DataFrame:
    return as_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), F.col("doc_id"), F.col("text"), F.col("source"), F.lit(kind))


def naive_text(html: Column, limit: int | None = None) -> Column:
    """Scripts, styles and tags dropped, white space collapsed; entities stay. limit: characters kept, if any."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", " "), r"\s+", " "))
    return x if limit is None else F.substring(x, 1, limit)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return as_documents(p, F.col("page_id"), naive_text(F.col("html")), F.parse_url("url", F.lit("HOST")), F.lit("html"), F.col("html"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return as_documents(e, F.col("event_id"), F.col("props"), F.col("event_type"), F.lit("json"), F.col("props"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(table(spark, sf_dir, "conversations"))


def turns(c: DataFrame) -> DataFrame:
    """Turns of conversations, of a table or a stream, as documents."""
    return as_documents(c, F.concat_ws("-", "conv_id", "turn"), F.col("text"), F.col("role"), F.lit("text"))


JSONL = "id string, text string, source string, modality string, raw string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as documents. Blank lines are skipped and a malformed line fails the read; a missing id is the row's number in reading order."""
    number = F.monotonically_increasing_id()
    rows = spark.read.schema(JSONL).option("mode", "FAILFAST").json(path).withColumns({"_split": F.shiftright(number, 33), "_row": number.bitwiseAND((1 << 33) - 1)})
    if rows.where("id IS NULL").limit(1).count():  # a split's rows are numbered on from those of the splits before it
        sizes = rows.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"))
        first = sizes.select(F.col("_split").alias("_s"), (F.sum("_n").over(W.orderBy("_split")) - F.col("_n")).alias("_first"))  # a row for each split
        rows = rows.join(first, F.col("_split") == F.col("_s")).withColumn("_row", F.col("_row") + F.col("_first"))
    return as_documents(rows, F.coalesce("id", F.col("_row").cast("string")), F.col("text"), F.col("source"), F.coalesce("modality", F.lit("text")), F.col("raw"))


def draw(seed, key: Column, what: str, k: Column | int = 0) -> Column:
    """A number from 0 to 2**32 - 1 by a hash of seed, key, purpose and counter: the same on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"), key.cast("string"), F.lit(what), (F.lit(k) if isinstance(k, int) else k).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def pick(items: Sequence[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(n, F.lit(len(items))) + 1).cast("int"))


def _clean_text(seed: int, key: str) -> str:
    draw = lambda what, k=0: int.from_bytes(hashlib.md5(f"{seed}|{key}|{what}|{k}".encode(), usedforsecurity=False).digest()[:4], "big")
    pick = lambda items, n: items[n % len(items)]

    def sentence(k: int) -> str:
        lead = pick(X.CONNECTORS, draw("connector", k)) + " " if draw("connect", k) % 2 == 0 else ""
        whole = lead + " ".join((pick(X.SUBJECTS, draw("subject", k)), pick(X.VERBS, draw("verb", k)), pick(X.OBJECTS, draw("object", k))))
        return whole[:1].upper() + whole[1:] + pick((".", ".", ".", "?"), draw("end", k))

    sentences = [sentence(k) for k in range(1, draw("sentences") % 9 + 7)]
    parts = [pick(X.HEADINGS, draw(what)) for chance, share, what in (("head", 85, "heading"), ("sub", 45, "subheading")) if draw(chance) % 100 < share]
    for p in range(1, 8):
        n = draw("paragraph", p) % 3 + 2
        if sentences:
            parts.append(" ".join(sentences[:n]))
        sentences = sentences[n:]
    if draw("list") % 100 < 35:
        parts.append("\n".join("- " + pick(X.LIST_ITEMS, draw("item") + k) for k in range(1, draw("items") % 2 + 3)))
    return "\n\n".join(parts)


def clean_text(seed: int, key: Column) -> Column:
    """Six to fourteen sentences in paragraphs of two to four, often under a heading and before a short list. An Arrow function of the key: as expressions, all sentences were drawn anew for each paragraph."""

    @F.pandas_udf(StringType())
    def run(key: pd.Series) -> pd.Series:
        return pd.Series([_clean_text(seed, k) for k in key], dtype=object)

    return run(key)


def clean_corpus(spark: SparkSession, n: int = 400, seed: int = 7, modalities: Sequence[str] = ("html", "ocr", "json")) -> DataFrame:
    """A balanced clean corpus, drawn by hash: html rows have an article around the text as raw, json rows a record."""
    row = spark.range(n).withColumn("key", F.format_string("clean-%05d", "id"))
    key = F.col("key")
    base = row.select("key", F.col("id"), clean_text(seed, key).alias("text"), pick(X.CLEAN_SOURCES, draw(seed, key, "source")).alias("source"), pick(modalities, F.col("id")).alias("modality"))
    html = F.concat(F.lit("<html><body><article><p>"), F.replace("text", F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    tokens = F.regexp_extract_all("text", F.lit(X.TOKEN), F.lit(0))
    record = F.to_json(F.struct(
        F.format_string("rec-%06d", F.pmod(draw(seed, key, "rec"), F.lit(10**6))).alias("id"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/p/"), F.pmod(draw(seed, key, "url"), F.lit(10**5)).cast("string")).alias("url"),
        F.col("text"), F.lit("en").alias("lang"), F.size(tokens).alias("tokens"), F.array_join(F.slice(tokens, 1, 5), " ").alias("title"),
    ))
    return as_documents(base, key, F.col("text"), F.col("source"), F.col("modality"), F.when(F.col("modality") == "html", html).when(F.col("modality") == "json", record))
