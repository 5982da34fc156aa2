"""Make this package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows of an Arrow batch where the session leaves Spark's default: rows here hold whole texts and frames.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Send the package's modules along with the application, once, and bound what a Python worker holds at a time."""
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    handle, path = tempfile.mkstemp(prefix="lumenflow-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for p in sorted(root.rglob("*.py")):
            archive.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
