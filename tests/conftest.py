import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from arborlens.session import configure, shared_folder, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configure(SparkSession.builder.master("local[4]").appName("tests"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    ship(session, "arborlens", "checks")
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column builder on single values: ``values(build, type, *inputs)``."""
    def run(build, kind, *inputs):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        return [r["x"] for r in rows.select("i", build(rows["v"]).alias("x")).orderBy("i").collect()]

    return run
