"""What Python workers need of this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Hand this package's source to the Python workers, once a context; they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkpolicy_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # not itself imported from an archive
        out = Path(tempfile.mkdtemp(prefix="package-")) / "sparkpolicy_source.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
    sc._sparkpolicy_shipped = True
