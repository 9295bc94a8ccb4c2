"""Links in a listing that carries resolved paths: outside, dangling, duplicate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens import fixed_values as V


def inside(resolved: Column, root: Column) -> Column:
    """True if the resolved target is the root or lies below it."""
    return (resolved == root) | F.startswith(resolved, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def judge_links(listing: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows of a listing with ``reason_code`` and ``pruned_dir`` after the verdicts on links.

    ``tops`` holds ``repo_id`` and the real path of its root. A link is broken,
    leads outside, or, to a directory, shows what has another name: a real
    directory that is reached (listed and not pruned), or a link before it by
    name. Links to files inside stay, and links to directories that are reached
    by no other name; nothing is followed. Only links are looked up, each
    by its target among the directories; rows pruned before stay as they are.
    """
    open_rows = F.col("pruned_dir").isNull()
    links = listing.where(F.col("is_link")).join(tops.toDF("repo_id", "_top"), "repo_id", "left")
    gone = ~F.col("is_dir") & F.col("length").isNull()
    within = inside(F.col("resolved_path"), F.col("_top"))
    reached = listing.where(F.col("is_dir") & ~F.col("is_link") & open_rows).select(
        "repo_id", "resolved_path", F.lit(True).alias("_reached"))
    # Directories that the rules of names reject take no target away from others.
    first = links.where(F.col("is_dir") & open_rows & F.col("reason_code").isNull()).groupBy("repo_id", "resolved_path").agg(
        F.min("relative_path").alias("_first"))
    looked = links.join(reached, ["repo_id", "resolved_path"], "left").join(first, ["repo_id", "resolved_path"], "left")
    taken = F.col("_reached") | (F.col("resolved_path") == F.col("_top")) | (F.col("_first") != F.col("relative_path"))
    # Directories follow the rules of names first, files their links first.
    reason = F.when(gone, V.LINK_BROKEN).when(~within, V.LINK_OUTSIDE).when(F.col("is_dir") & F.coalesce(taken, F.lit(False)), V.LINK_DUPLICATE)
    fresh = open_rows & reason.isNotNull()
    judged = looked.withColumns({
        "reason_code": F.when(fresh, reason).otherwise(F.col("reason_code")),
        "pruned_dir": F.when(fresh & F.col("is_dir"), F.col("relative_path")).otherwise(F.col("pruned_dir")),
    })
    return listing.where(~F.col("is_link")).unionByName(judged.select(*listing.columns))
