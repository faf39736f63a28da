"""Make the package importable in Python workers of a running session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ARCHIVE = "centroidal_package.zip"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once.

    Not needed where it is installed on every node or passed with ``--py-files``.
    Spark copies the archive from the driver to each executor itself.
    """
    context = spark.sparkContext
    if _ARCHIVE not in context._python_includes:
        package = Path(__file__).resolve().parent
        stage = Path(tempfile.mkdtemp(prefix="centroidal-ship-"))
        ignore = shutil.ignore_patterns("__pycache__")
        shutil.copytree(package, stage / "tree" / package.name, ignore=ignore)
        archive = shutil.make_archive(str(stage / Path(_ARCHIVE).stem), "zip", stage / "tree")
        context.addPyFile(archive)
    return spark
