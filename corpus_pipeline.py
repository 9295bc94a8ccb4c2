"""From documents to packed sequences: quality, near duplicates, benchmark contamination, packing.

Each stage reads what the one before has written. All but the last return whole documents, with their columns; the last
returns the packed pieces. The quality stage drops documents with a score below one half; the near-duplicate stage keeps
the one with the smallest id of each group, where each row stands for its own text, also if its id is null or has other texts
(repeated rows count as copies, but rows with neither id nor words do not); the decontamination stage drops
contaminated documents and leaves all others as they are. Columns beyond ``doc_id`` and ``text`` pass through, whatever their names. Empty tables
stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm import decontaminate, near_dedup, packing, quality
from arborlens.llm.tables import given, hold


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, given(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_copies(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(docs, given(spark, sf_dir, "benchmark"))
    return decontaminate.drop_documents(docs, judged)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("near-dedup", keep_one_of_each), ("decontamination", keep_clean), ("packing", pack)]
ORACLE_SQL = None  # the scores of fitted trees and the places of packed pieces are not expressible; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
