"""Incremental run: enrich what is new or changed, keep the rest, drop the gone."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.fixed_values import CACHE_SCHEMA_VERSION
from arborlens.functions import structured
from arborlens.functions.content import content_hash
from arborlens.operators import enrich, summary_cache
from arborlens.operators.skew import settle
from arborlens.session import fresh_folder, shared_folder
from arborlens.sources import bucketed
from arborlens.sources.cache_store import CacheStore


class Step(NamedTuple):
    summaries: DataFrame
    fresh: DataFrame
    cache: DataFrame


def cache_rows(enriched: DataFrame, keys: DataFrame, config_hash: str,
               version: str = CACHE_SCHEMA_VERSION) -> DataFrame:
    """Enriched rows as cache rows, with the keys they were made for.

    Answers are checked here: one that is no JSON object, or that reports an
    error, becomes the error of its row and is not stored.
    """
    changed = F.col("modification_time") if "modification_time" in keys.columns else F.lit(None)
    said = structured.parse_summary(F.col("summary"), F.col("file_path"))["error"]
    judged = settle(enriched.select(*summary_cache.KEY, "summary", F.coalesce(F.col("error"), said).alias("error")), "error")
    checked = judged.withColumn("summary", F.when(F.col("error").isNull(), structured.json_part(F.col("summary"))))
    return checked.join(keys, summary_cache.KEY).select(
        *summary_cache.KEY, "content_hash", "language", "summary",
        changed.cast("timestamp").alias("modification_time"),
        F.lit(config_hash).alias("config_hash"), F.lit(version).alias("schema_version"), "error",
    )


def document_table(documents: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Documents bucketed by file, with the hashes of their texts.

    The texts are dealt once, here. Incremental runs over the table read hashes
    only, then the texts of misses, where they lie.
    """
    spark = documents.sparkSession
    hashed = documents.withColumn("content_hash", content_hash(F.col("content")))
    path = path or fresh_folder(spark, "documents")
    return bucketed.write(hashed, path, summary_cache.KEY, buckets or bucketed.buckets_of(spark))


def checkpointed(rows: DataFrame) -> DataFrame:
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def step(documents: DataFrame, cache: DataFrame, config_hash: str,
         run: Callable[[DataFrame], DataFrame] = enrich.default_enrich,
         hold: Callable[[DataFrame], DataFrame] = checkpointed) -> Step:
    """Summaries of all documents and the cache they leave behind.

    ``documents`` has ``repo_id, file_path, language, content``, and
    ``content_hash`` if it is known. One join labels every file; the labels and the
    fresh rows are held, as both are used more than once, so ``run`` is called once
    per miss. Rows of files whose description failed stay as they were.
    """
    usable = summary_cache.current(cache, config_hash)
    known = hold(summary_cache.compare(summary_cache.keyed(documents), usable))
    missed = known.where(F.col("state") == summary_cache.MISS)
    # The labels are the built side of the join, so that no text is sorted.
    names = missed.select(*summary_cache.KEY).hint("shuffle_hash")
    todo = documents.join(names, summary_cache.KEY, "left_semi")
    fresh = hold(cache_rows(run(todo), missed.select(*summary_cache.KEY, "now.*"), config_hash))
    hits = known.where(F.col("state") == summary_cache.HIT).select(*summary_cache.KEY, "cached.*")
    summaries = hits.select(*summary_cache.KEY, "summary", F.lit(None).cast("string").alias("error")).unionByName(
        fresh.select(*summary_cache.KEY, "summary", "error"))
    good = summary_cache.storable(fresh).drop("error")
    old = missed.where(F.col("cached").isNotNull()).select(*summary_cache.KEY, "cached.*")
    after = hits.unionByName(summary_cache.remove(old, good), allowMissingColumns=True).unionByName(good, allowMissingColumns=True)
    return Step(summaries, fresh, after)


def run_batch(documents: DataFrame, store: CacheStore, config_hash: str,
              run: Callable[[DataFrame], DataFrame] = enrich.default_enrich) -> DataFrame:
    """Bring the stored cache up to date with a full set of documents.

    Returns the summaries of all documents. Documents without ``content_hash``
    become a table of :func:`document_table` first.
    """
    if "content_hash" not in documents.columns:
        documents = document_table(documents, buckets=store.buckets)
    result = step(documents, store.read(), config_hash, run)
    store.write(result.cache)
    return result.summaries
