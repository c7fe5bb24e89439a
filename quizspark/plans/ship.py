"""Makes the package importable on Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the context's files, once. Spark serves them from the driver to every executor."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quizspark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quizspark-src-")) / "quizspark_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "quizspark").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    context._quizspark_shipped = True
