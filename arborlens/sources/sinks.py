"""Writers of documents, reports and tree texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["repo_id", "relative_path"]
STEP = 64  # split points that are looked at in one go
REPORTS = "repo_id string, report string, version bigint"


def _split_points(names: DataFrame, parts: int) -> list[tuple[str, str]]:
    """The first name of each of ``parts`` ranges of even size; a row per range reaches the driver."""
    dealt = names.select(*ORDER).repartitionByRange(parts, *ORDER)
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*ORDER)).alias("first"))
    return sorted(tuple(r["first"]) for r in firsts.collect())


def _range_of(points: list[tuple[str, str]]):
    """Number of the range that a row lies in, found in two steps."""
    key = F.struct(*(F.col(c) for c in ORDER))
    split = F.array(*[F.struct(*(F.lit(v).alias(c) for v, c in zip(point, ORDER))) for point in points])
    steps = F.array(*[F.struct(*(F.lit(v).alias(c) for v, c in zip(point, ORDER))) for point in points[::STEP]])
    block = F.greatest(F.size(F.filter(steps, lambda p: p <= key)) - 1, F.lit(0)) * STEP
    inside = F.size(F.filter(F.slice(split, block + 1, F.lit(STEP)), lambda p: p <= key))
    return F.greatest(block + inside - 1, F.lit(0)).cast("int")


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists",
                    partition_by: list[str] | None = None, names: DataFrame | None = None, parts: int | None = None) -> None:
    """Documents in path order, cut into ranges of about even numbers of files.

    Row groups then cover short ranges of ``repo_id``, so that reading one
    repository skips the rest, and a huge repository spans many files. The split
    points come from ``names``, a cheap table ``(repo_id, relative_path)`` such as
    the listing, so texts are read once and move once. Without it rows are written
    where they are: documents of a traversal of folders lie in order, as their
    names were dealt before they were read. With ``partition_by`` folders per value
    are written too; keep that for few values.
    """
    if names is not None:
        parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        points = _split_points(names, parts)
        if points:
            documents = documents.repartitionById(len(points), _range_of(points)).sortWithinPartitions(*(partition_by or []), *ORDER)
    writer = documents.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The last report ``(repo_id, report)`` of each repository in a report table."""
    rows = spark.read.schema(REPORTS).parquet(path)
    return rows.groupBy("repo_id").agg(F.max_by("report", "version").alias("report"))


def write_reports(reports: DataFrame, path: str, text: str, force: bool = False) -> None:
    """Append one report per repository to one table.

    A repository that has a report is an error unless ``force`` is set; then the
    new one counts and the reports of all others stay. For one writer at a time.
    """
    spark = reports.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    version = 0
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        known = spark.read.schema(REPORTS).parquet(path)
        version = (known.agg(F.max("version")).first()[0] or 0) + 1
        if not force:
            twice = known.join(reports.select("repo_id"), "repo_id", "left_semi").select("repo_id").first()
            if twice is not None:
                raise FileExistsError(f"{path} has a report for {twice[0]}")
    rows = reports.select("repo_id", F.col(text).alias("report"), F.lit(version).cast("bigint").alias("version"))
    rows.write.mode("append").parquet(path)


def export_report(spark: SparkSession, path: str, repo_id: str, target: str, force: bool = False) -> None:
    """The report of one repository as a text file in the folder ``target``."""
    mode = "overwrite" if force else "errorifexists"
    read_reports(spark, path).where(F.col("repo_id") == repo_id).select(F.col("report").alias("value")).coalesce(1).write.mode(mode).text(target)


def write_tree(pieces: DataFrame, path: str, force: bool = False) -> None:
    """Pieces of trees and file lists as a table, those of a repository side by side and in order."""
    mode = "overwrite" if force else "errorifexists"
    pieces.repartitionByRange("repo_id", "kind", "piece").sortWithinPartitions("repo_id", "kind", "piece").write.mode(mode).parquet(path)
