"""How the executors get this package: as a zip file, so that no installed copy is needed."""

from __future__ import annotations

import hashlib
import os
import tempfile
import weakref
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: "weakref.WeakSet[SparkContext]" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a context. What runs Python on them by module name calls this first."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    own = os.path.dirname(os.path.abspath(__file__))
    root, package = os.path.split(own)
    made_in = tempfile.mkdtemp(prefix="lodestone-")
    target = os.path.join(made_in, f"{package}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(own):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    # Named by its contents: a session that shipped other files before takes these beside them.
    with open(target, "rb") as f:
        named = os.path.join(made_in, f"{package}-{hashlib.sha256(f.read()).hexdigest()[:12]}.zip")
    os.rename(target, named)
    sc.addPyFile(named)
    _shipped.add(sc)
