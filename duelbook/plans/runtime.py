"""What a query needs from the session before it runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import duelbook


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers and make sure checkpoints have a folder.

    The checkpoint folder is the cluster's ``spark.checkpoint.dir``; only a local session
    without one gets a temporary folder.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_duelbook_shipped", False):
        root = os.path.dirname(os.path.abspath(duelbook.__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="duelbook-"), "duelbook.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.join("duelbook", os.path.relpath(path, root)))
        sc.addPyFile(archive)
        sc._duelbook_shipped = True
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="duelbook-checkpoint-"))
    return spark
