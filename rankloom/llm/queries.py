"""The operators as registered queries, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, decontaminate, html, jaccard, katz, language, periodic, pii, quality, ranked, repeats, urls, vectors
from rankloom.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language.bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    dictionaries = language.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    out = language.identify(docs, dictionaries)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(language.bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.train(docs, labels.where(~held_out))
    out = quality.score(docs, model)
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return out.select("doc_id", held_out.alias("held_out"), "score", predicted, "n_passages", "top_passage", "top_weight")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic.collapse_runs(periodic.planted(table(spark, sf_dir, "documents")))
    return runs.select("doc_id", *periodic.digests(runs))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return out.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of_them = (
        op1_decontamination, op2_embedding_near_dedup, op3_jaccard_join, op4_pii, op5_language_id, op6_katz_backoff, op7_quality, op8_url_filter,
        op9_bpe, op10_html_extraction, op11_periodic_runs, op12_ranked_search, op13_suffix_dedup,
    )
    return {f.__name__: f for f in all_of_them}


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": ranked.SQL, "op13_suffix_dedup": repeats.SQL}
