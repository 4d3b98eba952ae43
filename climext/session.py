"""Makes this package known to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship() -> None:
    """Send the package's source to the executors once in a session (they import it to run Arrow functions)."""
    spark = SparkSession.getActiveSession()
    if spark is None or getattr(spark.sparkContext, "_climext_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="climext-src-"), "climext_src.zip")  # driver only; Spark serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._climext_shipped = True
