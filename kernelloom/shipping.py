"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application.  In local mode their path is the driver's, and may
    have it already; elsewhere the driver's path says nothing about theirs."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    local = master == "local" or master.startswith("local[")
    paths = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or local and str(ROOT) in paths:
        return
    _shipped.add(app)
    archive = os.path.join(tempfile.mkdtemp(prefix="kernelloom-"), "kernelloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((ROOT / "kernelloom").rglob("*.py")):
            out.write(path, str(path.relative_to(ROOT)))
    spark.sparkContext.addPyFile(archive)
