"""Summary cache as a table: lookup, misses, upsert, invalidation, stale rows.

One row per ``(repo_id, file_path)``. Content is hashed where it is read and
stays out of every shuffle; joins see keys and hashes only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.fixed_values import CACHE_SCHEMA_VERSION
from arborlens.functions.content import content_hash

KEY = ["repo_id", "file_path"]
MATCH = KEY + ["content_hash", "language"]
SCHEMA = (
    "repo_id string, file_path string, content_hash string, language string, "
    "summary string, modification_time timestamp, config_hash string, schema_version string"
)
# ---- fixed values: what a stored cache document must hold --------------------
ENTRY_FIELDS = ("file_path", "content_hash", "language", "summary", "mtime")
ROOT_FIELDS = ("schema_version", "config_hash")


def keyed(documents: DataFrame, path: str = "file_path", language: str = "language",
          text: str = "content") -> DataFrame:
    """Cache keys of documents, without their text."""
    extra = [c for c in ("modification_time",) if c in documents.columns]
    hashed = F.col("content_hash") if "content_hash" in documents.columns else content_hash(F.col(text))
    return documents.select(
        "repo_id", F.col(path).alias("file_path"),
        hashed.alias("content_hash"), F.col(language).alias("language"), *extra,
    )


def current(cache: DataFrame, config_hash: str, version: str = CACHE_SCHEMA_VERSION) -> DataFrame:
    """Rows written under this configuration and version; others are void."""
    return cache.where((F.col("config_hash") == config_hash) & (F.col("schema_version") == version))


def lookup(keys: DataFrame, cache: DataFrame, config_hash: str,
           version: str = CACHE_SCHEMA_VERSION) -> DataFrame:
    """Keys with their cached summary, null on a miss."""
    return keys.join(current(cache, config_hash, version).select(*MATCH, "summary"), MATCH, "left")


def misses(keys: DataFrame, cache: DataFrame, config_hash: str,
           version: str = CACHE_SCHEMA_VERSION) -> DataFrame:
    """Keys without a usable summary."""
    usable = current(cache, config_hash, version).where(F.col("summary").isNotNull())
    return keys.join(usable.select(*MATCH), MATCH, "left_anti")


HIT, MISS, STALE = "hit", "miss", "stale"


def compare(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Every file of the documents or of the cache, with its ``state``, in one join.

    A hit is a file whose row was made for the same text and language, a miss any
    other file of the documents, and stale a row whose file is no longer there.
    ``keys`` come as they are (null for stale rows), the cache row as ``cached``
    (null for files it does not know). Of tables bucketed by file, no row moves.
    """
    now = keys.select(*KEY, F.struct(*[c for c in keys.columns if c not in KEY]).alias("now"))
    had = cache.select(*KEY, F.struct(*[c for c in cache.columns if c not in KEY]).alias("cached"))
    same = (F.col("now.content_hash") == F.col("cached.content_hash")) & (F.col("now.language") == F.col("cached.language"))
    state = F.when(F.col("now").isNull(), STALE).when(same & F.col("cached.summary").isNotNull(), HIT).otherwise(MISS)
    return now.join(had, KEY, "full_outer").withColumn("state", state)


def stale(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """Cached rows whose file is no longer there."""
    return cache.join(documents.select(*KEY), KEY, "left_anti")


def remove(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Cache without the given files."""
    return cache.join(keys.select(*KEY), KEY, "left_anti")


def remove_stale(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """Cache restricted to files that are still there."""
    return cache.join(documents.select(*KEY), KEY, "left_semi")


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The last row per file by ``order``, combined on the map side first."""
    fields = [c for c in rows.columns if c not in KEY + [order]]
    picked = rows.groupBy(*KEY).agg(
        F.max_by(F.struct(*fields), F.col(order)).alias("_row")
    )
    return picked.select(*KEY, "_row.*")


def storable(fresh: DataFrame, order: str | None = None) -> DataFrame:
    """Fresh rows without the failed ones; ``order`` says which one of a file is last."""
    good = fresh.where(F.col("error").isNull()) if "error" in fresh.columns else fresh
    return latest(good, order) if order else good


def upsert(cache: DataFrame, fresh: DataFrame, order: str | None = None) -> DataFrame:
    """New rows replace old rows of the same file; failed ones are not stored.

    Old rows only meet the new keys, so few changes never move the old table.
    """
    rows = storable(fresh, order).select(*cache.columns)
    return remove(cache, rows).unionByName(rows)


def valid_document(raw: Column) -> Column:
    """True if a stored cache text has the expected structure.

    Root and entries must be objects, and every entry must hold all fields.
    """
    root = F.try_parse_json(raw)
    kinds = F.schema_of_variant(root)
    entries = F.try_variant_get(root, "$.entries", "array<variant>")
    is_list = F.startswith(
        F.coalesce(F.schema_of_variant(F.try_variant_get(root, "$.entries", "variant")), F.lit("")),
        F.lit("ARRAY"),
    )

    def has(value: Column, name: str) -> Column:
        # A field that is present but null still counts.
        return F.try_variant_get(value, f"$.{name}", "variant").isNotNull()

    def entry_ok(entry: Column) -> Column:
        ok = F.startswith(F.schema_of_variant(entry), F.lit("OBJECT"))
        for name in ENTRY_FIELDS:
            ok = ok & has(entry, name)
        return F.coalesce(ok, F.lit(False))

    fields = F.lit(True)
    for name in ROOT_FIELDS:
        fields = fields & has(root, name)
    return F.coalesce(
        F.startswith(kinds, F.lit("OBJECT")) & fields & is_list & F.forall(entries, entry_ok),
        F.lit(False),
    )


def entries(stored: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries of valid stored cache texts; damaged ones give no rows."""
    root = F.try_parse_json(F.col(raw))
    # The test comes first in the same expression: Spark may reorder filters.
    listed = F.when(
        valid_document(F.col(raw)), F.try_variant_get(root, "$.entries", "array<variant>")
    )

    def text(name: str) -> Column:
        return F.try_variant_get(F.col("entry"), f"$.{name}", "string")

    return stored.select(
        "repo_id",
        F.try_variant_get(root, "$.config_hash", "string").alias("config_hash"),
        F.try_variant_get(root, "$.schema_version", "string").alias("schema_version"),
        F.explode(listed).alias("entry"),
    ).select(
        "repo_id", text("file_path").alias("file_path"), text("content_hash").alias("content_hash"),
        text("language").alias("language"),
        F.to_json(F.try_variant_get(F.col("entry"), "$.summary", "variant")).alias("summary"),
        F.timestamp_seconds(F.try_variant_get(F.col("entry"), "$.mtime", "double")).alias("modification_time"),
        "config_hash", "schema_version",
    )
