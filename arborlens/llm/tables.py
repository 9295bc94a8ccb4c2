"""Intermediate tables in the shared folder."""

from pyspark.sql import DataFrame, SparkSession

from arborlens.session import fresh_folder


def hold(rows: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write rows to the shared folder and read them back: one computation, lineage cut, safe when executors go."""
    path = fresh_folder(rows.sparkSession, name)
    rows.write.option("compression", compression).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"
