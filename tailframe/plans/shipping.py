"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a Spark application: their Python workers need not
    find it on a path of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    made = Path(tempfile.mkdtemp(prefix="tailframe-")) / "tailframe_package.zip"
    with zipfile.ZipFile(made, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(made))
    _shipped.add(context.applicationId)
