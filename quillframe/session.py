"""What every query needs of a session: the package on the Python workers' path, and batches of bounded size."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


#: Bytes of a batch of rows that goes to a Python worker, so that long texts don't make large batches.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for a context, and bound batches by their bytes unless the session does."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    if not getattr(sc, "_quillframe_sent", False):
        folder = Path(tempfile.mkdtemp(prefix="quillframe-package-"))
        copy = folder / "tree" / PACKAGE.name
        shutil.copytree(PACKAGE, copy, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(folder / PACKAGE.name), "zip", folder / "tree"))
        sc._quillframe_sent = True
    return spark
