"""File selection: directory pruning, the rule chain, content checks, outcomes."""

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlens import fixed_values as V
from arborlens.functions import content as C
from arborlens.functions import ignore, language, paths, rules
from arborlens.operators.skew import settle

COMPLETED, SKIPPED, FAILED = "completed", "skipped", "failed"
STAGES = ("directory", "filter", "binary", "load")
ROWS_PER_TASK = 200_000


def with_path_parts(files: DataFrame) -> DataFrame:
    """Add normal form, name, ending and display name of ``relative_path``."""
    path = F.col("relative_path")
    name = paths.base_name(path)
    return files.withColumns({
        "normal_path": paths.normalise(path),
        "file_name": name,
        "file_type": paths.extension(name),
    })


def with_metadata(files: DataFrame, content: str = "content") -> DataFrame:
    """Add name, ending and size: from the listing, else the encoded length."""
    name = paths.base_name(F.col("relative_path"))
    size = C.size_bytes(F.col(content))
    if "length" in files.columns:
        size = F.coalesce(F.col("length"), size)
    return files.withColumns({
        "file_name": name,
        "file_type": paths.extension(name),
        "file_size": size.cast("bigint"),
    })


def with_ignore_verdicts(files: DataFrame, lines: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``_ignored_dir`` (topmost ignored directory) and ``_ignored`` by the ignore lines of each repository.

    ``lines`` holds ``repo_id, ord, pattern``. Files are dealt by directory to as
    many tasks as the largest repository asks for, each of which gets the lines,
    one small text, compiles them once and judges its paths in order.
    """
    n = files.groupBy("repo_id").count().agg(F.max("count")).first()[0] or 0
    spread = max(1, -(-n // rows_per_task))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "pattern"))), lambda r: r["pattern"])
    dealt = files.withColumn("_task", F.pmod(F.xxhash64(paths.parent(F.col("relative_path"))), F.lit(spread))).withColumn(
        "_lines", F.lit(None).cast("array<string>"))
    rules = lines.groupBy("repo_id").agg(texts.alias("_lines")).withColumn(
        "_task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    both = dealt.unionByName(rules, allowMissingColumns=True).repartition("repo_id", "_task").sortWithinPartitions(
        "repo_id", "_task", F.col("_lines").isNull(), "relative_path")
    columns = files.columns
    is_dir = "is_dir" in columns

    def judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, matcher = object(), None
        for batch in batches:
            top, own = [], []
            names = zip(*(batch.column(c).to_pylist() for c in ("repo_id", "relative_path", "_lines")),
                        batch.column("is_dir").to_pylist() if is_dir else repeat(False))
            for key, path, text, folder in names:
                if text is not None or key != repo:
                    repo, matcher = key, ignore.Matcher(text) if text is not None else None
                if matcher is None or text is not None:
                    top.append(None)
                    own.append(False)
                else:
                    top.append(matcher.directory(path if folder else path.rpartition("/")[0]).ignored_dir)
                    own.append(matcher.ignored(path))
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(top, pa.string()), pa.array(own, pa.bool_())],
                names=[*columns, "_ignored_dir", "_ignored"])
            yield out.filter(batch.column("_lines").is_null())

    schema = T.StructType([*files.schema.fields, T.StructField("_ignored_dir", T.StringType()), T.StructField("_ignored", T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return both.mapInArrow(judge_rows, schema)


def judge(files: DataFrame, include=None, exclude=None, max_kb: int | None = V.DEFAULT_MAX_KB,
          ignore_rules: list[ignore.Rule] | DataFrame | None = None) -> DataFrame:
    """Add ``pruned_dir`` (topmost rejected directory) and ``reason_code``.

    A directory's verdict depends on its path alone, so every file works out
    the fate of its own ancestors: pruning needs no shuffle and no join. Rows of
    directories (``is_dir``) are judged as such and are never kept as files.
    ``ignore_rules`` is a list for all repositories, or a table of lines
    ``(repo_id, ord, pattern)``, for which names are dealt by directory.
    """
    rules.check_limit(max_kb)
    verdict, by_table = None, isinstance(ignore_rules, DataFrame)
    if by_table:
        files = with_ignore_verdicts(files, ignore_rules)
    elif ignore_rules:
        def verdict(p):
            return ignore.ignored_by(p, ignore_rules)

    def directory_reason(directory: Column, normal: Column) -> Column:
        reason = rules.name_reason(normal, include, exclude)
        if verdict is None:
            return reason
        ignored = F.when(ignore.directory_ignored(directory, verdict), V.GITIGNORED)
        return F.coalesce(reason, ignored)

    path, normal = F.col("relative_path"), F.col("_normal")
    # Each step is a column of its own: Spark then works it out once per row.
    files = files.withColumn("_normal", paths.normalise(path))
    above = paths.ancestors(path)
    look = rules.may_lie_in_rejected(normal, exclude)
    if "is_dir" in files.columns:
        above = F.when(F.col("is_dir"), F.array_append(above, path)).otherwise(above)
        look = look | F.col("is_dir")
    pairs = F.transform(
        above, lambda d: F.struct(d.alias("dir"), paths.normalise(d).alias("normal"))
    )
    rejected = F.filter(pairs, lambda d: directory_reason(d["dir"], d["normal"]).isNotNull())
    first = F.get(rejected, F.lit(0))
    files = files.withColumn("_top", first if verdict is not None else F.when(look, first))
    own = F.coalesce(
        rules.name_reason(normal, include, exclude), rules.size_reason(F.col("length"), max_kb)
    )
    if verdict is not None:
        own = F.coalesce(own, F.when(verdict(path), V.GITIGNORED))
    top, by_lines = F.col("_top.dir"), F.lit(False)
    if by_table:
        # Of two rejected directories above a path the shorter one is the topmost.
        own = F.coalesce(own, F.when(F.col("_ignored"), V.GITIGNORED))
        by_lines = F.col("_ignored_dir").isNotNull() & (top.isNull() | (F.length("_ignored_dir") < F.length(top)))
        top = F.when(by_lines, F.col("_ignored_dir")).otherwise(top)
    reason = F.when(by_lines, V.GITIGNORED).when(
        F.col("_top").isNotNull(), directory_reason(F.col("_top.dir"), F.col("_top.normal"))
    ).otherwise(own)
    judged = files.withColumns({"pruned_dir": top, "reason_code": reason}).drop("_normal", "_top", "_ignored_dir", "_ignored")
    return settle(judged, "pruned_dir", "reason_code")


def kept(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason_code").isNull())


def pruned_directories(judged: DataFrame) -> DataFrame:
    """One row per rejected directory, named with a closing slash."""
    return (
        judged.where(F.col("pruned_dir").isNotNull())
        .select(
            "repo_id",
            F.concat("pruned_dir", F.lit("/")).alias("relative_path"),
            F.lit(STAGES[0]).alias("stage"),
            "reason_code",
            F.lit(None).cast("string").alias("reason_detail"),
        )
        .distinct()
    )


def load(judged: DataFrame, max_kb: int | None = V.DEFAULT_MAX_KB, content: str = "content",
         error: str | None = None) -> DataFrame:
    """Turn judged files into outcomes: stage, reason and decoded text.

    ``content`` holds the bytes, or text that was decoded before. A column
    named by ``error`` carries read failures of the source. Files below pruned
    directories stay with stage ``directory``; they are not outcomes of their
    own, see :func:`outcomes`. ``rule_reason`` keeps the verdict of the rules,
    which needs no content.
    """
    files = judged.withColumnRenamed("reason_code", "rule_reason")
    rejected = F.col("rule_reason").isNotNull()
    raw = F.col(content)
    if files.schema[content].dataType.simpleString() == "string":
        raw = raw.cast("binary")
    failed = F.col(error) if error else F.lit(None).cast("string")
    # Rejected files end here: their content is never looked at. Each step is
    # a column of its own, so that the tests run once per file.
    files = files.withColumn(
        "_binary", F.when(~rejected & failed.isNull(), C.is_binary(raw))
    )
    files = files.withColumn("text", F.when(~F.col("_binary"), C.decode(raw)))
    files = settle(files, "_binary", "text")
    decoded = F.col("text").isNotNull()
    unexpected = F.coalesce(F.startswith(failed, F.lit(V.UNEXPECTED)), F.lit(False))
    return files.withColumns({
        "outcome": F.when(decoded, COMPLETED).when(~rejected & unexpected, FAILED).otherwise(SKIPPED),
        "stage": F.when(F.col("pruned_dir").isNotNull(), STAGES[0]).when(rejected, STAGES[1])
        .when(F.col("_binary"), STAGES[2]).when(~decoded, STAGES[3]),
        "reason_code": F.when(rejected, F.col("rule_reason"))
        .when(F.startswith(failed, F.lit(V.PERMISSION_ERROR)), V.PERMISSION_ERROR)
        .when(unexpected, V.UNEXPECTED)
        .when(failed.isNotNull(), V.LOAD_ERROR)
        .when(F.col("_binary"), V.BINARY)
        .when(~decoded, V.ENCODING),
        "reason_detail": F.when(
            F.col("rule_reason") == V.TOO_LARGE, rules.size_detail(F.col("length"), max_kb)
        ).otherwise(failed),
    }).drop("_binary")


def outcomes(loaded: DataFrame) -> DataFrame:
    """Files that were reached: neither directories nor below a pruned one."""
    reached = loaded.where(F.col("pruned_dir").isNull())
    return reached.where(~F.col("is_dir")) if "is_dir" in loaded.columns else reached


def documents(loaded: DataFrame) -> DataFrame:
    """The document table: kept files with their text, and their time if listed."""
    name = paths.base_name(F.col("relative_path"))
    extra = [c for c in ("modification_time",) if c in loaded.columns]
    return outcomes(loaded).where(F.col("outcome") == COMPLETED).select(
        "repo_id",
        paths.forward_slashes(F.col("relative_path")).alias("file_path"),
        name.alias("file_name"),
        paths.extension(name).alias("file_type"),
        "relative_path",
        F.col("text").alias("content"),
        *extra,
    )


def skipped(judged: DataFrame, loaded: DataFrame) -> DataFrame:
    """Skipped directories and files with stage, reason and detail."""
    files = outcomes(loaded).where(F.col("outcome") != COMPLETED)
    return pruned_directories(judged).unionByName(
        files.select("repo_id", "relative_path", "stage", "reason_code", "reason_detail")
    )


def errors(skips: DataFrame) -> DataFrame:
    """Skips that were failures to read, not decisions."""
    return skips.where(
        (F.col("stage") == STAGES[3]) & F.col("reason_code").isin(V.ENCODING, V.LOAD_ERROR, V.PERMISSION_ERROR, V.UNEXPECTED)
    )


def with_language(files: DataFrame, name: str = "file_name", text: str = "content") -> DataFrame:
    """Add ``language``, detected once from name and text."""
    return (
        files.withColumn("_sample", language.sample(F.col(text)))
        .withColumn("language", language.detect(F.col(name), F.col(text), F.col("_sample")))
        .drop("_sample")
    )
