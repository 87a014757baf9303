"""Send the package to the executors, so that it need not be installed there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def checkpoint_ready(spark: SparkSession) -> None:
    """Name a checkpoint folder where the session has none (tests on one machine)."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="mirrorlake-"))


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the Python path of the session's executors, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_mirrorlake_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="mirrorlake-")) / "mirrorlake.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        context.addPyFile(str(target))
        context._mirrorlake_shipped = True
    return spark
