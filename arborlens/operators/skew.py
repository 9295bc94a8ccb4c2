"""Helpers for the shape of plans: hot keys, and columns worked out once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlens.session import shared_folder

SALTS = 32


def join_per_key(facts: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str],
                 how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join many rows to one small row per key, when a key may hold most rows.

    Every key of ``per_key`` is copied to ``salts`` buckets and each fact row
    goes to one of them, so a hot key is spread over that many tasks. Spark
    still turns this into a broadcast join by itself when the side is small.
    """
    bucket = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = facts.withColumn("_salt", bucket)
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def positions(rows: DataFrame, group: list[str], order: list[str], place: str, total: str) -> DataFrame:
    """Number the rows of each group from 1 by ``order``, and add the size of the group.

    Rows are dealt out by ranges of group and order, numbered within each range
    and moved up by the sizes of the ranges before it. No task holds a whole
    group, and the numbers are the same for every number of ranges.
    """
    shared_folder(rows.sparkSession)
    # Held first, as finding the ranges reads the rows as well; then again, so that ranges stay as they are.
    dealt = rows.checkpoint().repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias(total))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return dealt.withColumn(place, inside).join(sizes, [*group, "_range"]).withColumn(
        place, (F.col("_start") + F.col(place)).cast("bigint")).drop("_range", "_start")


def settle(rows: DataFrame, *names: str) -> DataFrame:
    """Fix computed columns, so that filters on them do not compute them again.

    Spark moves a filter below the projection it refers to by copying the
    projected expression into it. It does not move one below a generator.
    """
    keep = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns if c not in names]
    return rows.select(*keep, F.inline(F.array(F.struct(*names))))
