"""Document versions as a stream of summaries, on keyed state.

The state of a file is the last version seen, whether it was a deletion, what
its summary was made for, and, while a description has failed, the version to be
tried again. It lies in Spark's state store, so a restart goes on where the
stream was and a replayed batch changes nothing; the changes are an append-only
table, in which a file's last good row counts (:func:`summaries`).

Spark keeps one value per bucket of files, as each call for a value goes to the
JVM and back: the calls of a batch grow with its files up to the number of
buckets, not beyond.
"""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from arborlens.fixed_values import CACHE_SCHEMA_VERSION
from arborlens.functions import structured
from arborlens.functions.content import content_hash
from arborlens.operators import summary_cache
from arborlens.operators.skew import settle

VERSIONS = (
    "repo_id string, file_path string, language string, content string, "
    "modification_time timestamp, version bigint, deleted boolean"
)
# ``removed`` rows tell of deletions; ``error`` rows of descriptions that failed and are tried again.
CHANGES = summary_cache.SCHEMA + ", version bigint, removed boolean, error string"
_SAID = ("repo_id string, file_path string, content_hash string, language string, answer string, "
         "modification_time timestamp, version bigint, removed boolean, error string")
_STATE = "version bigint, deleted boolean, content_hash string, language string, config_hash string"
_WAITING = "language string, content string, content_hash string, modification_time timestamp, version bigint"
_FILES = f"files array<struct<repo_id string, file_path string, {_STATE}, due bigint>>"
BUCKETS = 1 << 14  # a task holds the new texts of one: 8 TB of them in a batch are 500 MB in each
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Describe(StatefulProcessor):
    """Per file: the last version counts; describe it if its text or language is new.

    ``make()`` returns the user's function from a row (a dict) to an answer. A
    failed version is kept, and a timer asks again once ``retry_ms`` have passed,
    until it succeeds or a later version takes its place.
    """

    def __init__(self, make: Callable[[], Callable[[dict], str]], config_hash: str, retry_ms: int = 1):
        self._make, self._config, self._retry = make, config_hash, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._call = self._make()
        self._handle = handle
        self._known = handle.getValueState("known", _STATE)
        self._waiting = handle.getValueState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = None
        for row in rows:  # versions of one file may be many: only the last is held
            if row["version"] is not None and (last is None or row["version"] > last["version"]):
                last = row
        if last is None:
            return
        known = self._known.get()  # each call asks the store in the JVM: none is made in vain
        if known is not None and last["version"] <= known[0]:
            return
        if last["deleted"]:
            self._known.update((last["version"], True, None, None, None))
            self._stop_waiting(known)
            if known is not None and not known[1]:
                yield self._row(key, last, removed=True)
            return
        made_for = (last["content_hash"], last["language"], self._config)
        if known is not None and tuple(known[2:]) == made_for:  # the summary at hand is still right
            self._known.update((last["version"], False, *made_for))
            self._stop_waiting(known)
            return
        yield self._describe(key, last, known, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self._waiting.exists():
            return  # a later version has come since
        language, content, hashed, changed, version = self._waiting.get()
        row = Row(language=language, content=content, content_hash=hashed, modification_time=changed, version=version)
        yield self._describe(key, row, self._known.get(), timerValues)

    def _describe(self, key, row: Row, known, timers) -> Row:
        answer = error = None
        try:
            answer = self._call({"repo_id": key[0], "file_path": key[1], "language": row["language"], "content": row["content"]})
            error = self._fault(answer)
        except Exception as problem:  # noqa: BLE001 - any failure is the row's own
            error = f"{type(problem).__name__}: {problem}"
        if error is None:
            self._known.update((row["version"], False, row["content_hash"], row["language"], self._config))
            self._stop_waiting(known)
        else:
            # What is stored was made for an older text, if for any: it is no hit for a later version.
            self._known.update((row["version"], False, *(known[2:] if known is not None else (None, None, None))))
            self._waiting.update((row["language"], row["content"], row["content_hash"], row["modification_time"], row["version"]))
            self._handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self._retry)
        return self._row(key, row, answer, error)

    def _stop_waiting(self, known) -> None:
        """A file that was not known before has no version that waits."""
        if known is not None:
            self._waiting.clear()

    @staticmethod
    def _fault(answer: str | None) -> str | None:
        return structured.summary_fault(answer)

    @staticmethod
    def _row(key, row: Row, answer: str | None = None, error: str | None = None, removed: bool = False) -> Row:
        return Row(
            repo_id=key[0], file_path=key[1], content_hash=row["content_hash"], language=row["language"], answer=None if error else answer,
            modification_time=row["modification_time"], version=row["version"], removed=removed, error=error)

    def close(self) -> None:
        pass


class _Files:
    """The files of the bucket at hand, and the state of one of them as :class:`Describe` asks for it."""

    def __init__(self, handle: StatefulProcessorHandle):
        self._handle = handle
        self._stored = handle.getValueState("files", _FILES)
        self.texts = handle.getMapState("texts", "repo_id string, file_path string", _WAITING)

    def open(self) -> None:
        """Ask for all files of the bucket."""
        stored = self._stored.get()
        self.held = {tuple(file[:2]): tuple(file[2:]) for file in (stored[0] if stored else ())}
        self._before, self._timers = dict(self.held), set()

    def store(self) -> None:
        if self.held != self._before:
            self._stored.update(([(*file, *value) for file, value in self.held.items()],))

    def due(self) -> int | None:
        """When the version of this file that waits is to be tried again; null if none waits."""
        return self.held[self.file][-1] if self.file in self.held else None

    def set_due(self, time: int | None) -> None:
        self.held[self.file] = (*self.held[self.file][:-1], time)

    def getValueState(self, name: str, schema: str) -> "_Known | _Waiting":
        return {"known": _Known, "waiting": _Waiting}[name](self)

    def registerTimer(self, time: int) -> None:
        self.set_due(time)
        if time not in self._timers:
            self._handle.registerTimer(time)
            self._timers.add(time)


class _Known:
    def __init__(self, files: _Files):
        self._files = files

    def get(self) -> tuple | None:
        value = self._files.held.get(self._files.file)
        return None if value is None else value[:-1]

    def update(self, value: tuple) -> None:
        self._files.held[self._files.file] = (*value, self._files.due())


class _Waiting:
    """Versions that wait are rare, and their texts are long: each has a value of its own."""

    def __init__(self, files: _Files):
        self._files = files

    def exists(self) -> bool:
        return self._files.due() is not None

    def get(self) -> tuple:
        return self._files.texts.getValue(self._files.file)

    def update(self, value: tuple) -> None:
        self._files.texts.updateValue(self._files.file, value)

    def clear(self) -> None:
        if self.exists():
            self._files.texts.removeKey(self._files.file)
            self._files.set_due(None)


class DescribeBucket(StatefulProcessor):
    """:class:`Describe` for each file of a bucket."""

    def __init__(self, make: Callable[[], Callable[[dict], str]], config_hash: str, retry_ms: int = 1):
        self._each = Describe(make, config_hash, retry_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._files = _Files(handle)
        self._each.init(self._files)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last: dict[tuple, Row] = {}
        for row in rows:
            file = row["repo_id"], row["file_path"]
            if row["version"] is not None and (file not in last or row["version"] > last[file]["version"]):
                last[file] = row
        self._files.open()
        for file, row in last.items():
            self._files.file = file
            yield from self._each.handleInputRows(file, iter([row]), timerValues)
        self._files.store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._files.open()
        time = expiredTimerInfo.getExpiryTimeInMs()
        for file in [file for file, value in self._files.held.items() if value[-1] is not None and value[-1] <= time]:
            self._files.file = file
            yield from self._each.handleExpiredTimer(file, timerValues, expiredTimerInfo)
        self._files.store()

    def close(self) -> None:
        self._each.close()


def changes(versions: DataFrame, config_hash: str, make: Callable[[], Callable[[dict], str]], retry_ms: int = 1,
            buckets: int = BUCKETS) -> DataFrame:
    """The stream of changes (``CHANGES``) that a stream of document versions makes.

    ``buckets`` must stay as it is for as long as the checkpoint is used.
    """
    hashed = versions.select(
        F.pmod(F.xxhash64("repo_id", "file_path"), F.lit(buckets)).alias("bucket"), "repo_id", "file_path", "language", "content", content_hash(F.col("content")).alias("content_hash"),
        "modification_time", "version", F.coalesce(F.col("deleted"), F.lit(False)).alias("deleted"))
    said = hashed.groupBy("bucket").transformWithState(
        DescribeBucket(make, config_hash, retry_ms), _SAID, "append", "processingTime")
    return said.select(
        "repo_id", "file_path", "content_hash", "language", structured.json_part(F.col("answer")).alias("summary"),
        "modification_time", F.lit(config_hash).alias("config_hash"), F.lit(CACHE_SCHEMA_VERSION).alias("schema_version"),
        "version", "removed", "error")


def start(versions: DataFrame, path: str, config_hash: str, checkpoint: str,
          make: Callable[[], Callable[[dict], str]], retry_ms: int = 1, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Append the changes to the table at ``path``. Each stream has a table and a checkpoint of its own.

    Versions come from an append-only table of documents: a file stream reports
    a path once, so files changed in place or deleted would be missed.

    A stream that runs on (``processingTime=...``) asks again for failed
    descriptions also while nothing new comes. One that ends when all is read
    (``availableNow``) does so with its next batch of new versions.
    """
    trigger = trigger or {"availableNow": True}
    conf = versions.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # With timers, Spark would go on to run empty batches for ever.
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str("availableNow" not in trigger).lower())
    return (
        changes(versions, config_hash, make, retry_ms, buckets).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def told(spark: SparkSession, *paths: str) -> DataFrame:
    """All changes that streams have written."""
    tables = [spark.read.schema(CHANGES).parquet(path) for path in paths]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def summaries(changes: DataFrame) -> DataFrame:
    """Cache rows of files that are there: the last change of each that is no failure."""
    last = settle(summary_cache.latest(changes.where(F.col("error").isNull()).withColumn("_order", F.col("version")), "_order"), "removed")
    return last.where(~F.col("removed")).select(*[field.split()[0] for field in summary_cache.SCHEMA.split(", ")])
