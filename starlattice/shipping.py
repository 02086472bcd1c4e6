"""Making this package importable in Python workers that were not started from its folder."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Send the package as a zip file once a session, unless PYTHONPATH or the working folder already leads to it."""
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    app = spark.sparkContext.applicationId
    if _ROOT in map(os.path.realpath, known) or os.path.realpath(_ROOT) in map(os.path.realpath, known) or app in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, names in os.walk(os.path.join(_ROOT, "starlattice")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, _ROOT))
    path = os.path.join(tempfile.mkdtemp(prefix="starlattice-ship-"), "starlattice.zip")
    with open(path, "wb") as file:
        file.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
