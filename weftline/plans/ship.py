"""Brings this package to executors that don't have it on their path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Once a session: adds the package as a zip file, unless PYTHONPATH already brought it to the workers."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    if root in str(sc.environment.get("PYTHONPATH", "")).split(os.pathsep) or root in sc.getConf().get("spark.executorEnv.PYTHONPATH", "").split(os.pathsep):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for path in [*Path(root, "weftline").rglob("*.py"), *Path(root).glob("corpus_pipeline.py")]:
            z.write(path, path.relative_to(root))
    folder = tempfile.mkdtemp()
    path = Path(folder, "weftline.zip")
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
