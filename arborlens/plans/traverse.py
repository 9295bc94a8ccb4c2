"""From listings to judged files, outcomes, documents and the dry run."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens import fixed_values as V
from arborlens.operators import manifest, report, select
from arborlens.sources import corpus, ignore_files


class Traversal(NamedTuple):
    judged: DataFrame
    loaded: DataFrame

    @property
    def outcomes(self) -> DataFrame:
        return select.outcomes(self.loaded)

    @property
    def documents(self) -> DataFrame:
        return select.documents(self.loaded)

    @property
    def skipped(self) -> DataFrame:
        return select.skipped(self.judged, self.loaded)

    @property
    def dry_run(self) -> DataFrame:
        return report.dry_run(self.loaded)


def traverse(files: DataFrame, include=None, exclude=None, max_kb: int | None = V.DEFAULT_MAX_KB,
             ignore_rules=None) -> Traversal:
    """Run the rules and the content checks over a table of files with content."""
    judged = select.judge(files, include, exclude, max_kb, ignore_rules)
    error = "read_error" if "read_error" in files.columns else None
    return Traversal(judged, select.load(judged, max_kb, error=error))


def traverse_folders(spark: SparkSession, roots: dict[str, str] | DataFrame, include=None, exclude=None,
                     max_kb: int | None = V.DEFAULT_MAX_KB, respect_ignore_files: bool = False,
                     partitions: int | None = None) -> Traversal:
    """List the roots, judge names and sizes, and read only what is kept."""
    if isinstance(roots, dict):
        roots = spark.createDataFrame(sorted(roots.items()), "repo_id string, root string")
    lines = ignore_files.rule_lines(roots) if respect_ignore_files else None

    def judge(files: DataFrame) -> DataFrame:
        return select.judge(files, include, exclude, max_kb, lines)

    # Without include patterns nothing can bring an ignored directory back, so
    # no task need open it; with them, the verdict on each directory decides.
    closed = () if include else tuple(d for d in V.IGNORED_DIRS if "/" not in d and "*" not in d)
    # The walk is done once and held: names only, and every later step sees the
    # same files even if the trees change meanwhile.
    listing = corpus.scan(spark, roots, closed=closed, judge=judge)
    tops = roots.select("repo_id", corpus.real_roots("root").alias("top"))
    judged = manifest.judge_links(judge(listing).checkpoint(), tops).checkpoint()
    wanted = (
        F.col("reason_code").isNull() & F.col("pruned_dir").isNull() & ~F.col("is_dir")
    )
    loaded = corpus.read_content(judged.where(wanted), partitions)
    rest = judged.where(~wanted).withColumns({
        "content": F.lit(None).cast("binary"), "read_error": F.lit(None).cast("string"),
    })
    return Traversal(judged, select.load(loaded.unionByName(rest), max_kb, error="read_error"))
