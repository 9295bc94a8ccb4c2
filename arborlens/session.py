"""Session settings and the shared folder for intermediate tables."""

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the operators count on. Sizes follow the cluster and are left alone.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors reach.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset
    and all runs in this process, as in local tests, a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="arborlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: str) -> None:
    """Send packages that are not installed on the executors along with the job."""
    root = Path(__file__).resolve().parent.parent
    for package in packages or (Path(__file__).resolve().parent.name,):
        key = (spark.sparkContext.applicationId, package)
        if key in _shipped:
            continue
        target = Path(tempfile.mkdtemp(prefix="arborlens-ship-")) / f"{package}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted((root / package).rglob("*.py")):
                archive.write(source, source.relative_to(root).as_posix())
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(key)
