"""This package, sent to wherever Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the session's workers import this package: by path on this machine, as a zip from the driver elsewhere; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    above = os.path.dirname(package)
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if above not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([above, *filter(None, paths)])
    if context.master.startswith("local[") or context.master == "local":
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerline-"), "ledgerline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, files in os.walk(package):
            for name in sorted(f for f in files if f.endswith(".py")):
                whole = os.path.join(folder, name)
                packed.write(whole, os.path.relpath(whole, above))
    context.addPyFile(path)
