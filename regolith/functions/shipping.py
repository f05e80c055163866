"""Makes the package importable for Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of the package's sources to the application, once."""
    context = spark.sparkContext
    if getattr(context, "_regolith_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="regolith-")) / "regolith.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    context._regolith_shipped = True
