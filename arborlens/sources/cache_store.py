"""Versioned cache table: Spark writes a folder for each state, then one pointer to the one in force."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.operators.summary_cache import KEY, SCHEMA
from arborlens.sources import bucketed

KEPT = 2  # states that stay: the one in force, and the one before it for those who still read it


class CacheStore:
    """Cache states below one folder, for one writer at a time.

    A commit writes a new folder, bucketed by file, and then replaces the
    pointer. A run that dies before that leaves the last state in force, and
    what is being read is not written. On a cluster's file system the pointer is
    replaced in one step; on a local disk there is a moment between the two.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets or bucketed.buckets_of(spark)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._pointer = self._hadoop.Path(f"{self.path}/current.json")
        self._files = self._pointer.getFileSystem(spark._jsc.hadoopConfiguration())

    def _states(self) -> list[dict]:
        """The states that are kept, the one in force first."""
        if not self._files.exists(self._pointer):
            return []
        return json.loads(self.spark.read.text(f"{self.path}/current.json", wholetext=True).first()[0])["states"]

    def read(self) -> DataFrame:
        """The rows in force; empty before the first commit."""
        for state in self._states()[:1]:
            return bucketed.read(self.spark, f"{self.path}/{state['folder']}", SCHEMA, KEY, state["buckets"])
        return self.spark.createDataFrame([], SCHEMA)

    def write(self, rows: DataFrame) -> None:
        """Commit a whole new state, which may be derived from the last :meth:`read`."""
        before, folder = self._states(), f"state-{uuid.uuid4().hex}"
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        bucketed.write(rows.select(*names), f"{self.path}/{folder}", KEY, self.buckets)
        states = [{"folder": folder, "buckets": self.buckets}, *before]
        self._point(json.dumps({"states": states[:KEPT]}))
        for old in states[KEPT:]:
            bucketed.forget(self.spark, f"{self.path}/{old['folder']}")
            self._files.delete(self._hadoop.Path(f"{self.path}/{old['folder']}"), True)

    def _point(self, text: str) -> None:
        draft = self._hadoop.Path(f"{self.path}/next.json")
        out = self._files.create(draft, True)
        out.write(text.encode())
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        how = self.spark._sc._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self._pointer.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._files.makeQualified(draft), self._files.makeQualified(self._pointer), how)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored cache texts ``(repo_id, raw)`` below ``path/repo_id=<id>/``, one file a row."""
    folder = F.regexp_extract("_metadata.file_path", r"repo_id=([^/]*)/", 1)
    return spark.read.text(path, wholetext=True).select(
        F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("repo_id"),
        F.col("value").alias("raw"),
    )
