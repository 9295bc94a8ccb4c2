"""The whole run: from source trees to one report per repository."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.operators import enrich, graph, refine, rollup, select, tree
from arborlens.plans import incremental
from arborlens.plans.traverse import traverse_folders
from arborlens.session import fresh_folder
from arborlens.sources import sinks
from arborlens.sources.cache_store import CacheStore


class FullRun(NamedTuple):
    documents: DataFrame
    directories: DataFrame
    skipped: DataFrame
    dry_run: DataFrame
    degrees: DataFrame
    summaries: DataFrame
    attempts: DataFrame
    reports: DataFrame


def full_run(spark: SparkSession, roots: dict[str, str], store: CacheStore, config_hash: str,
             generate: Callable[[dict], str], review: Callable[[str], tuple[float, str]],
             describe: Callable[[DataFrame], DataFrame] = enrich.default_enrich,
             condense: Callable[[str, list[str]], str] = rollup.as_lines,
             summarise: Callable[[str, str], str] = rollup.count_contents,
             merge: Callable[[str, list[str]], str] = rollup.merge_counts,
             include=None, exclude=None, max_kb: int | None = V.DEFAULT_MAX_KB,
             respect_ignore_files: bool = False, output: str | None = None,
             force: bool = False, concurrency: int | None = None) -> FullRun:
    """Select, read, describe, roll up, write and review, and keep the best texts.

    ``describe`` enriches documents, ``summarise`` and ``merge`` describe
    directories from the JSON text of their contents, ``condense`` makes one text
    of a bounded list of items, ``generate`` and ``review`` run per repository on
    a row with ``k``, ``overview``, ``contents``, ``documents``, ``total_bytes`` and
    ``tree``, the table of trees and file lists (see ``tree.tree_and_files``), in
    ``concurrency`` tasks. Reports and trees go below ``output``. What is used more than once is
    written to the shared folder first: documents, degrees, fresh summaries and
    attempts. No step brings a whole repository into one task.
    """
    run = traverse_folders(spark, roots, include, exclude, max_kb, respect_ignore_files)
    folder = fresh_folder(spark, "documents")
    sinks.write_documents(select.with_language(run.documents), folder)
    documents = spark.read.parquet(folder)

    degrees = graph.degrees(graph.links(documents)).checkpoint()
    overviews = graph.overview(degrees)

    summaries = incremental.run_batch(documents, store, config_hash, describe)
    good = summaries.where(F.col("error").isNull()).withColumn(
        "description", F.get_json_object("summary", "$.description")
    )
    good = good.checkpoint()
    said = rollup.summarise_directories(good, summarise, merge)
    contents = rollup.condense(rollup.roll_up(good, directories_said=said), condense)

    trees = f"{output}/trees" if output else fresh_folder(spark, "trees")
    sinks.write_tree(tree.tree_and_files(documents), trees, force)

    repositories = documents.groupBy(F.col("repo_id").alias("k")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("content")).alias("total_bytes")
    )
    keys = (
        repositories
        .join(overviews.withColumnRenamed("repo_id", "k"), "k", "left")
        .join(contents.withColumnRenamed("repo_id", "k"), "k", "left")
        .fillna("", ["overview", "contents"])
        .withColumn("tree", F.lit(trees))
    )
    attempts = refine.refine(keys, generate, review, concurrency=concurrency)
    best = refine.best_texts(attempts).select(F.col("k").alias("repo_id"), "best_score", "text")
    reports = best.join(overviews, "repo_id", "left").select(
        "repo_id", "best_score", graph.append_section(F.col("text"), F.col("overview")).alias("report")
    )
    if output:
        sinks.write_reports(reports, f"{output}/reports", "report", force)
    return FullRun(documents, said, run.skipped, run.dry_run, degrees, summaries, attempts, reports)
