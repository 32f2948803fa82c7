"""Makes this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the application, once; nothing to do where PYTHONPATH already has it."""
    root = Path(__file__).resolve().parent.parent
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(root) in on_path or app in _shipped:
        return
    at = Path(tempfile.mkdtemp(prefix="folioscope-ship-")) / "folioscope.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "folioscope").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
