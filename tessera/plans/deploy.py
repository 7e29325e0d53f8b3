"""The package on the executors."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tessera


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers once per context, so that they need no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(tessera.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("tessera") / p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._tessera_shipped = True
