"""Session settings that every query of the library relies on."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC and adaptive execution; the number of shuffle partitions is left to the
#: cluster's own configuration.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, settings: Mapping[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("attestra")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.
    Where it isn't set, a temporary folder serves as long as all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that
    Python workers find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        out = tempfile.mkdtemp(prefix="attestra-ship-")
        copy = Path(out) / "source" / package.name
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/{package.name}", "zip", copy.parent))
        _shipped.add(app)
    return spark
