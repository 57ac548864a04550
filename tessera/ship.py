"""Ships this package to the executors' Python workers, as a job submitted with --py-files would."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: its workers need not find the package on a path of their own."""
    sc = spark.sparkContext
    if sc.applicationId not in _DONE:
        _DONE.add(sc.applicationId)
        home = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="tessera-")
        for top, folders, files in os.walk(home):
            folders[:] = [d for d in folders if d != "__pycache__"]
            to = os.path.join(folder, "src", os.path.basename(home), os.path.relpath(top, home))
            os.makedirs(to, exist_ok=True)
            for f in files:
                if f.endswith(".py"):
                    shutil.copy(os.path.join(top, f), to)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "tessera"), "zip", os.path.join(folder, "src")))
