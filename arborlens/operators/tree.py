"""Tree text as rows: one line per directory and file, with its place."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions import paths
from arborlens.operators.skew import positions

# In a sort key this ends the name of a directory, and this starts that of a
# file: a directory's own line comes first, then its files, then the rest.
END_OF_DIRECTORY, START_OF_FILE = "\x02", "\x01"


def lines(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Lines ``(repo_id, sort_key, depth, line)``: files of a directory, then subdirectories.

    The last file of a directory has its own mark. It is the largest path per
    directory and meets its file in a grouping by path, which is unique, so that
    a huge directory is never gathered in one task.
    """
    rows = files.select("repo_id", F.col(path).alias("path"))
    per_dir = rows.groupBy("repo_id", paths.parent(F.col("path")).alias("dir")).agg(
        F.max("path").alias("last")
    )

    def entry(where, is_dir: bool, is_last: bool):
        return F.struct(where.alias("path"), F.lit(is_dir).alias("is_dir"), F.lit(is_last).alias("is_last"))

    # Each directory with files names its last file, itself, all above and the top.
    above = F.array_append(paths.ancestors(F.col("dir")), F.col("dir"))
    named = F.concat(
        F.array(entry(F.col("last"), False, True), entry(F.lit(""), True, False)),
        F.transform(above, lambda d: entry(d, True, False)),
    )
    found = (
        rows.select("repo_id", "path", F.lit(False).alias("is_dir"), F.lit(False).alias("is_last"))
        .unionByName(per_dir.select("repo_id", F.inline(named)))
        .groupBy("repo_id", "path", "is_dir").agg(F.max("is_last").alias("is_last"))
    )
    top = F.col("is_dir") & (F.col("path") == "")
    name, home = paths.base_name(F.col("path")), paths.parent(F.col("path"))
    depth = F.when(top, 0).otherwise(paths.depth(F.col("path")) + 1).cast("int")
    key_of = F.when(home == "", "").otherwise(
        F.concat(F.translate(home, "/", END_OF_DIRECTORY), F.lit(END_OF_DIRECTORY))
    )
    sort_key = (
        F.when(top, "")
        .when(F.col("is_dir"), F.concat(key_of, name, F.lit(END_OF_DIRECTORY)))
        .otherwise(F.concat(key_of, F.lit(START_OF_FILE), name))
    )
    mark = F.when(F.col("is_last"), "└── ").otherwise("├── ")
    line = F.when(top, F.concat("repo_id", F.lit("/"))).otherwise(F.concat(
        F.repeat(F.lit("    "), depth), mark, name, F.when(F.col("is_dir"), "/").otherwise("")
    ))
    return found.select("repo_id", sort_key.alias("sort_key"), depth.alias("depth"), line.alias("line"))


LINES_PER_PIECE = 10_000


def pieces(rows: DataFrame, order: str, text: str, per_piece: int = LINES_PER_PIECE) -> DataFrame:
    """The texts of a repository in order, as numbered pieces ``(repo_id, piece, text)`` of ``per_piece`` lines."""
    named = rows.select("repo_id", F.col(order).alias("order"), F.col(text).alias("line"))
    placed = positions(named, ["repo_id"], ["order"], "place", "total")
    ordered = F.expr("listagg(line, '\n') within group (order by place)")
    return placed.groupBy("repo_id", F.floor((F.col("place") - 1) / per_piece).alias("piece")).agg(ordered.alias("text"))


def tree_and_files(files: DataFrame, path: str = "relative_path", per_piece: int = LINES_PER_PIECE) -> DataFrame:
    """For each repository the text of its tree and the list of its files ``(repo_id, kind, piece, text)``.

    Both are in pieces of bounded length, put together by ranges of places, so
    that no task holds a whole repository.
    """
    tree = pieces(lines(files, path), "sort_key", "line", per_piece).withColumn("kind", F.lit("tree"))
    names = pieces(files, path, path, per_piece).withColumn("kind", F.lit("files"))
    return tree.unionByName(names).select("repo_id", "kind", "piece", "text")
