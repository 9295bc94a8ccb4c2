"""Tables that lie bucketed by their keys, so that joins on the keys move no rows."""

import hashlib

from pyspark.sql import DataFrame, SparkSession


def write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write rows to a new folder, dealt once by their keys, one sorted file a bucket, and read them back."""
    dealt = rows.repartition(buckets, *keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(_name(path))
    return rows.sparkSession.table(_name(path))


def read(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """A folder that :func:`write` made, also in another session: its buckets are told to the catalog again."""
    by = ", ".join(keys)
    spark.sql(f"create table if not exists {_name(path)} ({schema}) using parquet "
              f"clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    return spark.table(_name(path))


def forget(spark: SparkSession, path: str) -> None:
    """Take a folder's name out of the catalog; its files stay."""
    spark.sql(f"drop table if exists {_name(path)}")


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _name(path: str) -> str:
    return f"arborlens_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
