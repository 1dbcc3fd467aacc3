"""Sends this package to the Python workers, once for each SparkContext."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship() -> None:
    context = SparkSession.getActiveSession().sparkContext
    if getattr(context, "_vellum_engine_shipped", False):
        return
    root = pathlib.Path(__file__).parent
    place = tempfile.mkdtemp(prefix="vellum-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    shutil.copytree(root, pathlib.Path(place, "tree", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{place}/{root.name}_engine", "zip", f"{place}/tree"))
    context._vellum_engine_shipped = True
