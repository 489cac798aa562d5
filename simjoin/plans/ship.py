"""Getting this package to the executors of a cluster where it is not installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Sends the package to all executors, present and future; returns the archive's path.

    Python workers import it by name, so a driver that merely has it on its own path needs
    this, or an installation on every machine.
    """
    home = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="simjoin-ship-")) / "simjoin.zip"  # the driver's own; Spark copies it
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(out))
    return str(out)
