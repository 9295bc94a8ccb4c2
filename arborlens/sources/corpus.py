"""Scan of source trees on a mounted file system.

Spark's own file sources leave out names that start with ``.`` or ``_``. This
source lists every name. It lists only; content is read later by
:func:`read_content`, for the files that the rules keep.
"""

import os
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.fixed_values import PERMISSION_ERROR, UNEXPECTED
from arborlens.session import shared_folder

LISTING = (
    "repo_id string, root string, relative_path string, length bigint, "
    "modification_time timestamp, is_dir boolean, is_link boolean, resolved_path string"
)
ROWS_PER_BATCH = 4096
BYTES_PER_BATCH = 16 * 1024 * 1024
UNITS_PER_CORE = 3
BUDGET = 4096  # names that a task lists from one directory of a round before it leaves the rest to the next

_ARROW = pa.schema([
    ("repo_id", pa.string()), ("root", pa.string()), ("relative_path", pa.string()),
    ("length", pa.int64()), ("modification_time", pa.timestamp("us", tz="UTC")),
    ("is_dir", pa.bool_()), ("is_link", pa.bool_()), ("resolved_path", pa.string()), ("unopened", pa.bool_()),
])


def local_path(path: str) -> str:
    """Plain path of a ``file:`` address; other schemes are not walked."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"a file walk needs a mounted path, got {path}; use scan_binary_files")
    return path


def _printable(text: str) -> str:
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def real_root(path: str) -> str:
    """The root with its own links resolved, as ``resolved_path`` shows it."""
    return _printable(os.path.realpath(local_path(path)))


def real_roots(root: str) -> Column:
    """The same for a column of roots, worked out by the tasks."""
    def resolved(roots: pd.Series) -> pd.Series:
        return roots.map(real_root)

    return F.pandas_udf(resolved, "string")(root)


def _row(repo, root, real, current, entry):
    link = entry.is_symlink()
    folder = entry.is_dir()
    target = os.path.realpath(entry.path) if link else os.path.join(real, current, entry.name)
    if not (link and not os.path.exists(target)) and not folder and not entry.is_file():
        return None  # neither a regular file nor a directory
    try:
        stat = entry.stat()
        size, changed = stat.st_size, int(stat.st_mtime * 1_000_000)
    except OSError:
        size, changed = None, None
    relative = os.path.join(current, entry.name).replace("\\", "/")
    return [repo, root, _printable(relative), None if folder else size, changed, folder, link, _printable(target), False]


def _listed(directory: str, is_root: bool) -> list[os.DirEntry]:
    """What lies in a directory; nothing if it cannot be opened."""
    try:
        with os.scandir(directory) as entries:
            return list(entries)
    except OSError as problem:
        if is_root:
            raise FileNotFoundError(f"Folder not found: {directory}") from problem
        return []


def _walker(closed: frozenset[str], budget: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, root, below in zip(*(c.to_pylist() for c in batch.columns)):
                root = local_path(root)
                real, rows, opened = os.path.realpath(root), [], 0
                todo = deque([(below, None)])
                while todo:
                    current, own = todo.popleft()
                    if opened >= budget:
                        own[8] = True  # left for the next round
                        continue
                    found = _listed(os.path.join(root, current), not current)
                    opened += len(found) + 1
                    for entry in found:
                        row = _row(repo, root, real, current, entry)
                        if row is None:
                            continue
                        rows.append(row)
                        # Links are listed, not followed.
                        if row[5] and not row[6] and entry.name not in closed:
                            todo.append((os.path.join(current, entry.name), row))
                for low in range(0, len(rows), ROWS_PER_BATCH):
                    yield _batch(rows[low:low + ROWS_PER_BATCH])

    return walk


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
    )


def scan(spark: SparkSession, roots: dict[str, str] | DataFrame, units: int | None = None,
         closed: tuple[str, ...] = (), judge: Callable[[DataFrame], DataFrame] | None = None,
         budget: int = BUDGET) -> DataFrame:
    """Listing of several roots, keyed by ``repo_id``; written down, so that it stays as it is.

    ``roots`` is a dictionary, or a table ``(repo_id, root)``. The trees are
    walked in rounds over a table of directories, spread over ``units`` tasks:
    from each directory a task goes down until it has seen about ``budget``
    names, and what it has not opened by then is the next round's table. So a
    tree is spread over all tasks wherever its files lie, and small trees take
    one round. ``judge`` adds ``pruned_dir`` to listed rows; directories that it
    rejects are not opened by a later round. ``closed`` names directories that
    no round opens. Directories that cannot be opened have no contents.
    """
    if isinstance(roots, dict):
        for root in roots.values():
            local_path(root)
        roots = spark.createDataFrame(sorted(roots.items()), "repo_id string, root string")
    units = units or UNITS_PER_CORE * spark.sparkContext.defaultParallelism
    shared_folder(spark)
    keys = ["repo_id", "root", "relative_path"]
    frontier = roots.select("repo_id", "root", F.lit("").alias("relative_path"))
    rounds = []
    while True:
        listed = frontier.select(*keys).repartition(units, *keys).mapInArrow(
            _walker(frozenset(closed), budget), LISTING + ", unopened boolean").checkpoint()
        rounds.append(listed.drop("unopened"))
        frontier = listed.where("unopened")
        if judge is not None:
            frontier = judge(frontier).where(F.col("pruned_dir").isNull())
        if frontier.isEmpty():
            return reduce(DataFrame.union, rounds)


def read_content(listing: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``content`` and ``read_error`` to listed files.

    Rows are dealt in ranges of paths first, names only, so that one huge
    directory does not stay with the task that listed it, and texts lie in path
    order without having moved. Batches are bounded by bytes, not rows.
    """
    keys = ["repo_id", "relative_path"]
    partitions = partitions or max(
        UNITS_PER_CORE * listing.sparkSession.sparkContext.defaultParallelism, int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = listing.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    names = spread.columns

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, contents, errors, held = 0, [], [], 0
            root, relative = batch.column("root"), batch.column("relative_path")
            for i in range(batch.num_rows):
                data, error = None, None
                try:
                    with open(os.path.join(root[i].as_py(), relative[i].as_py()), "rb") as handle:
                        data = handle.read()
                except OSError as problem:
                    error = f"{PERMISSION_ERROR}: {problem}"
                except Exception as problem:  # noqa: BLE001 - the failure of one file must not end the run
                    error = f"{UNEXPECTED}: {problem}"
                contents.append(data)
                errors.append(error)
                held += len(data or b"")
                if held >= BYTES_PER_BATCH or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        part.columns + [pa.array(contents, pa.binary()), pa.array(errors, pa.string())],
                        names=names + ["content", "read_error"],
                    )
                    start, contents, errors, held = i + 1, [], [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields)
    return spread.mapInArrow(load, fields + ", content binary, read_error string")


def scan_binary_files(spark: SparkSession, roots: dict[str, str], max_kb: int | None = None) -> DataFrame:
    """Listing with content by Spark's own reader, for any file system.

    Fast, and the size limit reaches the scan; but Spark leaves out empty files
    and names starting with ``.`` or ``_``. It suits only corpora without them.
    """
    parts = []
    for repo, root in sorted(roots.items()):
        top = root.rstrip("/") + "/"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        if max_kb is not None:
            files = files.where(F.col("length") <= max_kb * 1024)
        parts.append(files.select(
            F.lit(repo).alias("repo_id"), F.lit(root).alias("root"),
            F.substring_index("path", top, -1).alias("relative_path"), "length",
            F.col("modificationTime").alias("modification_time"),
            F.lit(False).alias("is_dir"), F.lit(False).alias("is_link"),
            F.col("path").alias("resolved_path"), "content",
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
