"""From raw documents to packed training sequences: toxicity, near-duplicates, personal data, source mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common, mixing, neardup, packing, pii, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels of these documents, doesn't reject.

    Null and empty texts stay; very long texts are scored whole; repeated rows are judged alike; columns of any name pass; an empty table or
    one without labelled rows rejects nothing.
    """
    return toxicity.filter_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked at a similarity of 0.8; documents without words or doc_id stay.

    Rows that repeat a doc_id and its text count once. Where a doc_id has different texts, each of them is a document of its own. Null and
    empty texts stay; very long texts are compared whole; of equal texts the smallest doc_id stays; columns of any name pass; an empty table
    gives no rows.
    """
    again = common.cut(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if not again.limit(1).count():
        found = neardup.near_duplicates(docs, threshold=80)
        return docs.join(common.cut(found.where("not kept and doc_id is not null").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
    single = docs.join(again, "doc_id", "left_anti")
    docs = common.cut(single.select(*docs.columns).unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)))
    row = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    keys = docs.select("doc_id", row.alias("row")).where("doc_id is not null")
    found = common.cut(neardup.near_duplicates(docs.select(row.alias("doc_id"), "text"), threshold=80).where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id"))
    member = found.join(keys, "row").select("row", "component_id", F.struct("doc_id", "row").alias("at"))
    first = member.groupBy("component_id").agg(F.min("at").alias("first"))
    dropped = common.cut(member.join(first, "component_id").where("at <> first").select("row"))
    own = common.free_name(docs, "row")
    return docs.withColumn(own, row).join(dropped.withColumnRenamed("row", own), own, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data.

    Null and empty texts stay; very long ones are searched whole, in linear time; repeated rows get equal texts; n_chars follows the new text;
    all other columns pass whatever their names; an empty table gives no rows.
    """
    return pii.with_surrogates(docs, counted=None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the source schedule, which partitions and files follow.

    Every row stays, also those without doc_id, source or text, repeated ones, and columns of any name; texts of any length are only carried; an
    empty table gives no rows.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences, which follow the order of docs.

    Null texts count as empty and are the end id alone; texts longer than a sequence are cut into pieces; repeated rows are packed each; rows
    without doc_id are packed; other columns, of any name, are dropped; an empty table gives no rows.
    """
    return packing.pack_in_order(docs, group_docs=packing.GROUP_DOCS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The fitted model and the tokenizer are beyond SQL; run() is tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows are Parquet in the shared checkpoint folder."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
