"""The package itself for the executors, where the cluster was not given it with ``--py-files``."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import civigrade

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once per application; Spark serves them from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(civigrade.__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="civigrade-"), "civigrade_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path("civigrade") / source.relative_to(root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
