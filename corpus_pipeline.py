"""The training-data pipeline: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, decontaminate, jaccard, language, pii
from rankloom.llm.common import bounded_batches, stored, table

#: SQL has no compression, alignment or tokenizer; tests compare the stages with plain Python.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not determined or too close between two."""
    bounded_batches(spark)
    learn = docs.where(F.coalesce(language.bucket_of(F.col("doc_id"), 4) != 2, F.lit(True)))
    judged = language.identify(docs, language.train(learn), keep=tuple(docs.columns))
    columns = [f"_k{k}" for k in range(len(docs.columns))]
    return judged.toDF("_id", "_lang", "_score", "_margin", "_rejected", *columns).where("not _rejected").select(*columns).toDF(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row of the least id; rows without an id or without shingles stay.

    An id may stand on several rows: each is judged by its own text, and goes only with its own group.
    """
    joined = stored(jaccard.join(docs, members=True).where("doc_id is not null"), "joined")
    first = joined.where("root is not null and doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("_id"), F.min("key").alias("_key"))
    alone = joined.where("root is null").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    kept = first.select("_id", "_key", F.lit(True).alias("_one")).union(alone.withColumn("_one", F.lit(False)))
    columns = [f"_c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*columns)
    row_id, text = (columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    named = rows.where(F.col(row_id).isNotNull()).withColumn("_id", F.col(row_id).cast("long")).withColumn("_key", jaccard.text_key(text))
    out = named.join(kept, ["_id", "_key"])
    if not joined.where("root is not null").groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        out = out.where("not _one").unionByName(out.where("_one").dropDuplicates(["_id", "_key"]))
    return out.select(*columns).union(rows.where(F.col(row_id).isNull())).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    bounded_batches(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; ``n_chars`` follows them."""
    bounded_batches(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    bounded_batches(spark)
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pii", mask_pii),
    ("bpe", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
