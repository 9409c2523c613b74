"""What jobs need of the cluster: this package on the workers, and a shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless PYTHONPATH has it already.

    Data sources and keyed stream processors also run in Python processes
    beside the driver, which read no sent files: they find the package by path.
    """
    package = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_netsift_shipped", False):
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [sc.environment.get("PYTHONPATH"), str(package.parent)]))
    built = Path(tempfile.mkdtemp(prefix="netsift-")) / f"{package.name}.zip"
    with zipfile.ZipFile(built, "w") as z:
        for source in package.rglob("*.py"):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(built))
    sc._netsift_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset and Spark runs in one process, a new temporary one.

    On a cluster the setting is required: executors cannot see each other's
    temporary folders.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="netsift-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")
