"""Making this package importable on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch, so that whole texts in flight stay small beside an executor's memory.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors and bound Arrow batches, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    for key, value in ARROW_LIMITS.items():
        spark.conf.set(key, value)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(package):  # imported from an archive, which was shipped already
        return
    name = os.path.basename(package)
    target = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(package)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(name, os.path.relpath(path, package)))
    sc.addPyFile(target)
