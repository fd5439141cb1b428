"""Put the package on executors that run its Python."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = pathlib.Path(__file__).resolve().parent.parent

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Needed where tasks run functions of the package and it is not installed there.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="snapledger-"))
    archive = pathlib.Path(folder) / "snapledger.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
