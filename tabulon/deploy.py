"""Makes this package importable on executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources with the jobs, once per application, unless PYTHONPATH already names them."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="tabulon-")) / "tabulon.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
