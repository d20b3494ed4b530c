"""Sessions: settings for large inputs, and this package's code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that let Spark plan anew by what it measures at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_SHIPPED: set[str] = set()


def session(name: str = "quilldex", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir.

    Only where it is unset and everything runs on one machine a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="quilldex-shared-")
        atexit.register(shutil.rmtree, local, True)
        spark.sparkContext.setCheckpointDir(local)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quilldex-code-")
    made = os.path.join(folder, "quilldex_code.zip")
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(made)
    atexit.register(shutil.rmtree, folder, True)  # executors fetch it from here
    _SHIPPED.add(sc.applicationId)
