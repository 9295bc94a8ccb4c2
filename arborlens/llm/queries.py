"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm import (
    centroids, chat, decontaminate, html_text, knn, near_dedup, packing, quality, token_counts, token_files, turn_trie, url_filter, warc)
from arborlens.llm.tables import given, hold
from arborlens.session import fresh_folder

RULES = [  # fixed values: host, path, verdict
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(given(spark, sf_dir, "documents"))


def section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(given(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.absolute(fresh_folder(spark, "warc"))
    sources = warc.write_responses(given(spark, sf_dir, "pages"), folder, "responses")
    return warc.file_fields(warc.write_derivatives(sources, folder, "derivatives"), folder)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality in ``labels`` under its id."""
    outcomes = given(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(given(spark, sf_dir, "pages"), outcomes, rules)


def token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    manifest = token_files.write_ids(given(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = token_files.read_ids(spark, folder, manifest).join(F.broadcast(token_files.starts(manifest)), "file")  # a row per file
    return rows.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(given(spark, sf_dir, "embeddings"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(given(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, remembered=1 << 20)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(given(spark, sf_dir, "pages")).select("page_id", "text")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


HARD_TEXT = r"\### Assistant: </turn> ok"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -7, whose texts hold marks and escapes."""
    kinds = "conv_id bigint, turn bigint, role string, text string"
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], kinds)
    rows = given(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.fields(hold(chat.chat(rows.union(hard)), "chats", compression="zstd"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(given(spark, sf_dir, "conversations"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(given(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": near_duplicates,
    "op2_section_tokens": section_tokens,
    "op3_warc_derivatives": warc_derivatives,
    "op4_quality": quality_scores,
    "op5_url_verdicts": url_verdicts,
    "op6_token_planes": token_planes,
    "op7_nearest": nearest,
    "op8_packing": packed,
    "op9_visible_text": visible_text,
    "op10_contamination": contamination,
    "op11_chats": chats,
    "op12_conversation_trie": conversation_trie,
    "op13_centroids": centroid_clusters,
    "pipeline": pipeline,
}
