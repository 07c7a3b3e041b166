"""Code on the Python workers, wherever this package was imported from."""

from __future__ import annotations

import importlib
import tempfile
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, so that what its modules keep lasts from task to task."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(), f"{root.name}.zip")  # only the driver reads it; Spark sends it on
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def pickled_by_value(*modules: str) -> None:
    """What is in these modules is sent with each plan that uses it: for data sources, which are planned in a process of their own."""
    for name in modules:
        cloudpickle.register_pickle_by_value(importlib.import_module(name))
