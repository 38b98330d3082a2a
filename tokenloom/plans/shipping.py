"""Gives the package to executors that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package along unless the workers' path or folder has it. Once for each application."""
    package = Path(__file__).resolve().parent.parent
    known = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    app = spark.sparkContext.applicationId
    if str(package.parent) in known or app in _DONE:
        return
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(os.path.abspath(path))
    _DONE.add(app)
