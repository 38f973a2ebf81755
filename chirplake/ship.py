"""Ships this package to the Python workers, so that they need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, hand the package's source to all executors through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    if here.suffix == ".zip" or not here.is_dir():
        return  # we run from a shipped package ourselves
    target = Path(tempfile.mkdtemp(prefix="chirplake-"), "chirplake-source.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, f"chirplake/{file.relative_to(here)}")
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
