"""weftlink: record linkage and data analytics on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

__version__ = "0.1.0"


def _let_workers_import() -> None:
    """Put the library's folder on the path of Python workers that run on this machine.

    On a cluster the package is shipped as usual (``--py-files`` or installed).
    """
    from pyspark import SparkContext

    root = str(Path(__file__).resolve().parent.parent)
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    if (sc := SparkContext._active_spark_context) is not None:
        own = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in own:
            sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, own)])


_let_workers_import()
