"""Make this package importable on the executors of a session that was started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        to = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), "tidemark.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(to)
        _shipped.add(sc.applicationId)
    return spark
