"""Gives the executors this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame

import fieldcast


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once its session's executors can import this package.

    The sources go to the executors as a zip file over Spark's own file server,
    once per application, so nothing has to be installed on them.
    """
    sc = df.sparkSession.sparkContext
    name = "fieldcast-sources.zip"
    if not any(f.endswith(name) for f in sc.listFiles):
        top = os.path.dirname(os.path.abspath(fieldcast.__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="fieldcast-"), name)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
    return df
