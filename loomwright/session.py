"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the workers, unless their PYTHONPATH has it already; once for each application."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "loomwright_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for module in sorted((root / "loomwright").rglob("*.py")):
                z.write(module, module.relative_to(root))
        spark.sparkContext.addPyFile(str(path))
        spark.sparkContext.parallelize([0], 1).count()  # fetched before the folder goes
    _shipped.add(app)
