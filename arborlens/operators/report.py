"""Cost, skip counts, progress facts and the dry-run report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.functions import content as C
from arborlens.operators.select import COMPLETED, FAILED, SKIPPED
from arborlens.operators.skew import positions


def cost(documents: DataFrame, by: list[str] | None = None, text: str = "content") -> DataFrame:
    """Estimated tokens, bytes and documents, per group or overall."""
    body = F.col(text)
    return documents.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(C.tokens(body)), F.lit(0)).cast("bigint").alias("estimated_tokens"),
        F.coalesce(F.sum(C.size_bytes(body)), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count(F.lit(1)).cast("bigint").alias("documents"),
    )


def reason_rank(reason: Column) -> Column:
    """Place of a reason in reports: the named ones first."""
    place = F.array_position(F.array(*[F.lit(r) for r in V.REASON_ORDER]), reason)
    return F.coalesce(F.nullif(place, F.lit(0).cast("bigint")), F.lit(99).cast("bigint"))


def reason_totals(loaded: DataFrame) -> DataFrame:
    """Files, tokens and bytes per repository and reason (null: selected).

    One pass over the files. A pruned directory counts once, however many files
    lie below it; both groupings combine on the map side first.
    """
    if "is_dir" in loaded.columns:
        loaded = loaded.where(~F.col("is_dir") | F.col("pruned_dir").isNotNull())
    selected = F.col("outcome") == COMPLETED
    per_directory = loaded.groupBy("repo_id", "pruned_dir", "reason_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(selected, C.tokens(F.col("text"))).otherwise(0)).alias("tokens"),
        F.sum(F.when(selected, C.size_bytes(F.col("text"))).otherwise(0)).alias("bytes"),
    )
    once = F.when(F.col("pruned_dir").isNull(), F.col("n")).otherwise(1)
    return per_directory.groupBy("repo_id", "reason_code").agg(
        F.sum(once).cast("bigint").alias("n"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.sum("bytes").cast("bigint").alias("bytes"),
    )


def skip_counts(loaded: DataFrame) -> DataFrame:
    """Skips per repository and reason, with the reason's place in reports."""
    return reason_totals(loaded).where(F.col("reason_code").isNotNull()).select(
        "repo_id", "reason_code", F.col("n").alias("skipped"),
        reason_rank(F.col("reason_code")).alias("place"),
    )


def dry_run(loaded: DataFrame) -> DataFrame:
    """One row per repository: selected files, tokens, size text, skips by reason.

    The number of reasons is fixed, so the text of a report stays small.
    """
    reason = F.col("reason_code")
    lines = F.array_sort(F.collect_list(
        F.when(reason.isNotNull(), F.struct(reason_rank(reason).alias("p"), reason.alias("r"), "n"))
    ))
    report = reason_totals(loaded).groupBy("repo_id").agg(
        F.sum(F.when(reason.isNull(), F.col("n")).otherwise(0)).alias("files_selected"),
        F.sum("tokens").alias("estimated_tokens"),
        F.sum("bytes").alias("total_bytes"),
        F.sum(F.when(reason.isNotNull(), F.col("n")).otherwise(0)).alias("skipped"),
        lines.alias("_lines"),
    )
    text = F.array_join(
        F.transform("_lines", lambda x: F.concat(x["r"], F.lit(": "), x["n"].cast("string"))), "\n"
    )
    return report.select(
        "repo_id", "files_selected", "estimated_tokens", "total_bytes",
        C.format_size(F.col("total_bytes")).alias("request_size"), "skipped",
        text.alias("skip_summary"),
    )


def event_type() -> Column:
    """The event of a file that has been dealt with."""
    return F.when(F.col("outcome") == COMPLETED, "file_completed").when(F.col("outcome") == SKIPPED, "file_skipped").otherwise("file_failed")


def event_detail() -> Column:
    """Why a file was skipped, or what went wrong."""
    return F.when(F.col("outcome") == FAILED, F.coalesce("reason_detail", "reason_code")).otherwise(F.col("reason_code"))


def progress(outcomes: DataFrame) -> DataFrame:
    """One discovery event per repository, then one terminal event per file.

    Files rejected by the rules are counted first, as they never reach the
    later stages; within that, by path, whatever the size of the repository.
    """
    names = outcomes.select(
        "repo_id", "relative_path", F.col("rule_reason").isNull().cast("int").alias("_late"),
        event_type().alias("event_type"), event_detail().alias("detail"),
    )
    numbered = positions(names, ["repo_id"], ["_late", "relative_path"], "completed", "total").select(
        "repo_id", "event_type", "completed", "total", "relative_path", "detail"
    )
    none = F.lit(None).cast("string")
    discovery = numbered.where(F.col("completed") == 1).select(
        "repo_id", F.lit("files_discovered").alias("event_type"),
        F.lit(0).cast("bigint").alias("completed"), "total",
        none.alias("relative_path"), none.alias("detail"),
    )
    return discovery.unionByName(numbered)
