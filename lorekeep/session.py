"""What a session needs before queries run on it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def prepared(spark: SparkSession) -> SparkSession:
    """Give the executors this package, unless they find it on their path; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_lorekeep_ready", False):
        return spark
    sc._lorekeep_ready = True
    if str(PACKAGE.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        # the driver serves the archive to the executors itself; it isn't read from a folder of theirs
        archive = os.path.join(tempfile.mkdtemp(prefix="lorekeep-"), "lorekeep.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent))
        sc.addPyFile(archive)
    return spark
