"""Directory facts and roll-up of file summaries."""

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.fixed_values import ROLLUP_THRESHOLD
from arborlens.functions import paths
from arborlens.operators.skew import join_per_key, positions
from arborlens.session import fresh_folder, shared_folder

CONTENTS_PER_CALL = 1000
RUNS_AT_ONCE = 16  # runs that are Python values at a time


def usable(summaries: DataFrame) -> DataFrame:
    """Summaries with a file path, the only ones that enter the tree."""
    return summaries.where(F.coalesce(F.col("file_path"), F.lit("")) != "")


def directories(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Every directory with its direct files, child directories and all files below.

    Files are first counted per directory, so that only directories, not files,
    are expanded to their ancestors.
    """
    direct = files.groupBy("repo_id", paths.parent(F.col(path)).alias("dir")).agg(
        F.count(F.lit(1)).alias("n")
    )
    lines = F.array_append(paths.ancestors(F.col("dir")), F.col("dir"))
    known = direct.where(F.col("dir") != "").select(
        "repo_id", "n", F.col("dir").alias("own"), F.explode(lines).alias("dir")
    ).groupBy("repo_id", "dir").agg(
        F.sum(F.when(F.col("dir") == F.col("own"), F.col("n")).otherwise(0)).alias("n_files"),
        F.sum("n").alias("n_below"),
    )
    zero = F.lit(0).cast("bigint")
    tops = direct.where(F.col("dir") == "").select(
        "repo_id", "dir", F.col("n").alias("n_files"), zero.alias("n_dirs"), zero.alias("n_below")
    )
    # A directory counts once for its parent, and brings its own facts along.
    links = known.select("repo_id", F.inline(F.array(
        F.struct("dir", "n_files", zero.alias("n_dirs"), F.col("n_below").alias("n_below")),
        F.struct(
            paths.parent(F.col("dir")).alias("dir"), zero.alias("n_files"),
            F.lit(1).cast("bigint").alias("n_dirs"), zero.alias("n_below"),
        ),
    )))
    return tops.unionByName(links).groupBy("repo_id", "dir").agg(
        F.sum("n_files").cast("bigint").alias("n_files"),
        F.sum("n_dirs").cast("bigint").alias("n_dirs"),
        F.sum("n_below").cast("bigint").alias("n_below"),
    )


def tree_facts(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Directories below the top with direct files and child directories."""
    return directories(files, path).where(F.col("dir") != "").select("repo_id", "dir", "n_files", "n_dirs")


def _common_directory(low: Column, high: Column) -> Column:
    """Deepest directory that both paths lie in, part by part."""
    a, b = F.split(low, "/"), F.split(high, "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    keep = F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)))
    return F.array_join(F.slice(a, F.lit(1), F.least(keep, F.size(a) - 1, F.size(b) - 1)), "/")


def representatives(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Each directory below the top and the item that stands for it in its parent.

    A directory with two or more items has a summary of its own. One with a
    single item passes that item up: the first directory below it that
    branches, or its only file. That is the common directory of the smallest
    and the largest path below it, compared part by part; no loop is needed.
    """
    # '/' sorts before every other character here, so that paths order by parts.
    key = F.translate(F.col(path), "/", "\x01")
    direct = files.groupBy("repo_id", paths.parent(F.col(path)).alias("own")).agg(
        F.min(key).alias("low"), F.max(key).alias("high")
    ).where(F.col("own") != "")
    lines = F.array_append(paths.ancestors(F.col("own")), F.col("own"))
    ends = direct.select("repo_id", F.explode(lines).alias("dir"), "low", "high").groupBy(
        "repo_id", "dir"
    ).agg(
        F.translate(F.min("low"), "\x01", "/").alias("low"),
        F.translate(F.max("high"), "\x01", "/").alias("high"),
    )
    only = F.col("low") == F.col("high")
    item = F.when(only, F.col("low")).otherwise(_common_directory(F.col("low"), F.col("high")))
    return ends.select(
        "repo_id", "dir", item.alias("representative"),
        (~only & (item == F.col("dir"))).alias("summarised"),
    )


def default_description(n_files: Column, n_dirs: Column, n_below: Column) -> Column:
    return F.concat(
        n_files.cast("string"), F.lit(" files and "), n_dirs.cast("string"),
        F.lit(" directories, "), n_below.cast("string"), F.lit(" files in all"),
    )


def roll_up(summaries: DataFrame, threshold: int = ROLLUP_THRESHOLD, directories_said: DataFrame | None = None) -> DataFrame:
    """Top-level items ``(repo_id, file_path, kind, description)`` per repository.

    Repositories with at most ``threshold`` summaries keep them as they are.
    The others list their top-level files and what stands for each top-level
    directory, described by ``directories_said`` (of :func:`summarise_directories`
    with the same threshold), or by the default description.
    """
    files = usable(summaries).select("repo_id", "file_path", "description")
    sizes = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    stands = representatives(files).where(F.instr("dir", "/") == 0).select(
        "repo_id", F.col("representative").alias("file_path"), F.lit(True).alias("stands")
    )
    # Directories: what stands for a top-level one, described.
    if directories_said is None:
        said = directories(files).where(F.col("dir") != "").withColumn(
            "description", default_description(F.col("n_files"), F.col("n_dirs"), F.col("n_below")))
    else:
        said = directories_said.withColumn(
            "description", F.coalesce(F.get_json_object("summary", "$.description"), "summary", "error"))
    described = said.select(
        "repo_id", F.col("dir").alias("file_path"), F.lit("directory").alias("kind"), "description")
    rolled = join_per_key(
        stands.join(described, ["repo_id", "file_path"]), sizes, ["repo_id"], ["file_path"], "inner"
    ).where(F.col("n") > threshold)
    # Files: all of a small repository, those at the top, those that stand for a
    # directory. Paths are unique, so the join with ``stands`` cannot be skewed.
    own = join_per_key(
        files.join(stands, ["repo_id", "file_path"], "left"), sizes, ["repo_id"], ["file_path"], "inner"
    ).where((F.col("n") <= threshold) | (F.instr("file_path", "/") == 0) | F.col("stands"))
    out = ["repo_id", "file_path", "kind", "description"]
    return rolled.select(*out).unionByName(own.withColumn("kind", F.lit("file")).select(*out))


def contents_text(contents: list[str]) -> str:
    """Summaries of a directory's contents as one JSON list."""
    return json.dumps([json.loads(c) for c in contents], indent=2)


def _counted(where: str, files: int, dirs: int, below: int) -> str:
    said = f"{files} files and {dirs} directories, {below} files in all"
    return json.dumps({"file_path": where, "description": said, "files": files, "directories": dirs, "files_in_all": below})


def count_contents(where: str, contents: str) -> str:
    """The default summary of a part of a directory: how many files and directories its contents are."""
    items = json.loads(contents)
    below = [item["files_in_all"] for item in items if "files_in_all" in item]
    return _counted(where, len(items) - len(below), len(below), len(items) - len(below) + sum(below))


def merge_counts(where: str, parts: list[str]) -> str:
    """The default summary of a directory from those of its parts."""
    rows = [json.loads(p) for p in parts]
    return _counted(where, *(sum(r[k] for r in rows) for k in ("files", "directories", "files_in_all")))


def as_lines(where: str, contents: list[str]) -> str:
    """The items as lines."""
    return "\n".join(contents)


def condense(items: DataFrame, call: Callable[[str, list[str]], str],
             per_call: int = CONTENTS_PER_CALL, merge: Callable[[str, list[str]], str] = as_lines) -> DataFrame:
    """One text ``(repo_id, contents)`` of the items of each repository.

    ``call`` gets runs of up to ``per_call`` items in path order; ``merge``,
    which must be associative, puts their texts, one or many, together in that order.
    """
    rows = items.select(
        "repo_id", F.lit(".").alias("dir"), F.col("file_path").alias("item"),
        F.concat_ws(": ", "file_path", "description").alias("summary"),
    )
    return _fold(rows, call, merge, per_call).select(
        "repo_id", F.coalesce("summary", "error").alias("contents")
    )


RUN_OUT = "repo_id string, dir string, place bigint, blocks bigint, summary string, error string"
_ITEM = ["repo_id", "dir", "item", "summary"]


def _homes(facts: DataFrame) -> DataFrame:
    """For every directory the nearest summarised one, itself or above: ``repo_id, dir, home``; null if there is none."""
    own = facts.where("summarised").select("repo_id", F.col("dir").alias("above"), F.lit(True).alias("hit"))
    lines = F.array_append(paths.ancestors(F.col("dir")), F.col("dir"))
    return facts.select("repo_id", "dir", F.explode(lines).alias("above")).join(own, ["repo_id", "above"], "left").groupBy(
        "repo_id", "dir").agg(F.max_by("above", F.when(F.col("hit"), F.length("above"))).alias("home"))


def summarise_directories(summaries: DataFrame, call: Callable[[str, str], str] = count_contents,
                          merge: Callable[[str, list[str]], str] = merge_counts,
                          threshold: int = ROLLUP_THRESHOLD, per_call: int = CONTENTS_PER_CALL) -> DataFrame:
    """Directory summaries ``(repo_id, dir, summary, error)`` from user functions.

    ``call`` gets a directory and the summaries of a part of its contents as one
    JSON list (:func:`contents_text`), in order of their names; ``merge``, which
    must be associative, always gets the texts of the parts, be it one or many: a
    directory of any size is treated alike, and no task ever holds more than
    ``per_call`` items of it.

    Works from the deepest directories up. Every file and every directory is an
    item of the nearest summarised directory above it; it is written once, to
    the folder of that directory's level, and a level reads its own folder only.
    """
    spark = summaries.sparkSession
    files = usable(summaries)
    big = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)
    files = files.join(big.select("repo_id"), "repo_id", "left_semi").select("repo_id", "file_path", "summary")
    shared_folder(spark)
    facts = representatives(files).checkpoint()
    homes = _homes(facts).checkpoint()
    folder = fresh_folder(spark, "levels")

    def routed(items: DataFrame, home: Column) -> DataFrame:
        return items.withColumn("level", F.coalesce(paths.depth(home), F.lit(-1)))

    parts = homes.select("repo_id", F.col("dir").alias("at"), F.col("home").alias("dir"))
    held = files.select("repo_id", paths.parent(F.col("file_path")).alias("at"), F.col("file_path").alias("item"), "summary")
    routed(held.join(parts, ["repo_id", "at"]).where(F.col("dir").isNotNull()).select(_ITEM), F.col("dir")).write.partitionBy(
        "level").parquet(f"{folder}/files")
    own = facts.where("summarised").select("repo_id", "dir", paths.parent(F.col("dir")).alias("at"))
    own = own.join(parts.withColumnRenamed("dir", "home"), ["repo_id", "at"], "left").select("repo_id", "dir", "home", paths.depth(F.col("dir")).alias("depth"))
    own.write.partitionBy("depth").parquet(f"{folder}/directories")

    def read(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    known = read("directories", "repo_id string, dir string, home string, depth int")
    levels = sorted((r["depth"] for r in known.select("depth").distinct().collect()), reverse=True)
    done: list[DataFrame] = []
    for level in levels:
        items = read("files", "repo_id string, dir string, item string, summary string, level int").where(F.col("level") == level).select(_ITEM)
        for below in done:
            items = items.union(below.where(F.col("level") == level).select(
                "repo_id", F.col("home").alias("dir"), F.col("dir").alias("item"), _said().alias("summary")))
        said = _fold(items, lambda where, texts: call(where, contents_text(texts)), merge, per_call)
        here = known.where(F.col("depth") == level).drop("depth")
        name = f"said-{level}"
        routed(said.join(here, ["repo_id", "dir"]), F.col("home")).write.partitionBy("level").parquet(f"{folder}/{name}")
        done.append(read(name, "repo_id string, dir string, summary string, error string, home string, level int"))
    if not done:
        return spark.createDataFrame([], "repo_id string, dir string, summary string, error string")
    return reduce(DataFrame.union, done).select("repo_id", "dir", "summary", "error")


def _said() -> Column:
    """The summary of a directory, or its failure as a parent sees it."""
    return F.coalesce(
        "summary", F.to_json(F.struct(F.col("dir").alias("file_path"), "error"))
    )


def _fold(items: DataFrame, call, merge, per_call: int) -> DataFrame:
    """One summary per directory: runs of ``per_call`` items in order of their names, merged in that order, also if it is one.

    A failed run makes its directory fail, with the first error.
    """
    def over(function):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, RUNS_AT_ONCE):
                    out = []
                    for row in batch.slice(at, RUNS_AT_ONCE).to_pylist():
                        summary, error = None, next((r["error"] for r in row["run"] if r["error"] is not None), None)
                        try:
                            summary = function(row["dir"], [r["summary"] for r in row["run"]]) if error is None else None
                        except Exception as problem:  # noqa: BLE001 - any failure is the directory's own
                            error = f"{type(problem).__name__}: {problem}"
                        out.append((row["repo_id"], row["dir"], row["block"], row["blocks"], summary, error))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, kind) for v, kind in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                        names=["repo_id", "dir", "place", "blocks", "summary", "error"])
        return run

    key = ["repo_id", "dir"]
    runs, function, done = positions(items, key, ["item"], "place", "blocks").select(
        *key, (F.col("place") - 1).alias("place"), "blocks", "summary", F.lit(None).cast("string").alias("error")), call, None
    merged = False
    while True:
        # A run is one row: its items are few, and a task passes over many runs at a time.
        runs = runs.withColumn("block", F.floor(F.col("place") / per_call)).groupBy(*key, "block").agg(
            F.ceil(F.first("blocks") / per_call).alias("blocks"),
            F.array_sort(F.collect_list(F.struct("place", "summary", "error"))).alias("run"),
        ).mapInArrow(over(function), RUN_OUT).checkpoint()
        if merged:
            whole = runs.where(F.col("blocks") == 1).select(*key, "summary", "error")
            done = whole if done is None else done.unionByName(whole)
            runs = runs.where(F.col("blocks") > 1)
            if runs.isEmpty():
                return done
        function, merged = merge, True
