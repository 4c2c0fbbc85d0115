"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, digests, embeddings, minhash, oracles, packing, phrases, quality
from . import secret_scan, spelling, toxicity, url_filter, warc, windows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = url_filter.suspicious(F.col("url"), F.col("html"))
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), bad=label)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, clusters=minhash.labelled(docs))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(read(spark, sf_dir, "documents"), ranks, with_ids=False)


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, chat.ASSISTANT, said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    whole = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return digests.conversation_digests(chat.format_conversations(whole))


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    all_spans = F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", ","))
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]

    def of(kind: str):
        return F.filter("_all", lambda span: span.startswith(f"{kind}:"))

    base = F.filter("_all", lambda span: F.split_part(span, F.lit(":"), F.lit(1)).isin(kinds))
    return found.withColumn("_all", all_spans).select(
        "doc_id",
        *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in kinds],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        "spans",
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.fit_rules(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule",
    )


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, keep=["doc_id"]).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured"
    )


def window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return windows.pack_windows(read(spark, sf_dir, "documents"), tokenizer)


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_filters,
        "op2_best_fit_packing": best_fit_packing,
        "op3_byte_bpe": byte_bpe,
        "op4_chat_formatting": chat_formatting,
        "op5_secret_scans": secret_scans,
        "op6_quality_rules": quality_rules,
        "op7_toxicity": toxicity_scores,
        "op8_minhash_near_dedup": minhash_groups,
        "op9_embedding_near_dedup": embedding_groups,
        "op10_warc": warc_archives,
        "op11_window_packing": window_packing,
        "op12_phrase_collocations": phrase_collocations,
        "op13_spelling_variants": spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.build()
