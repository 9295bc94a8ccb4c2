"""Connected components of a graph that lies in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.tables import hold


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the links ``(a, b)``; the label is the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label of that label, so that long chains end in
    logarithmically many rounds. Hubs are met by map-side minima and by joins that adaptive execution can split.
    Repeated links, both directions and self links are fine; no links give an empty table.
    """
    both = hold(
        links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").filter("node <> other").distinct(), "links")
    labels = hold(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = hold(
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node").agg(F.min("label").alias("near")), "near")
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        lower = hold(lower, "lower")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = hold(
            lower.join(jump, "next", "left")
            .select("node", F.least("next", F.coalesce("far", "next")).alias("label"),
                    (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between nodes, of which some may have no label yet."""
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = links.select("a", "b").join(known, "a", "left").join(other, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(between)
    old = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select(
        "node", F.coalesce("new", "label").alias("label"))
    return hold(old.union(joined.join(labels, "node", "left_anti").select("node", "label")), "labels")
