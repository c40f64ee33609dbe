"""A PySpark-native engine for building and evaluating recommenders and for preparing corpora."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Send this package's sources to the executors, once per Spark context, so that they need not have it
    installed."""
    context = spark.sparkContext
    if getattr(context, "_marlstone_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    context.addPyFile(target)
    context._marlstone_shipped = True
