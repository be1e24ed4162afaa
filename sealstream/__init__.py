"""Verifiable device telemetry on Spark: admission, commitment, projection, verification."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors, once per application, so Python workers can import
    it wherever the session was started from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(context._temp_dir, "sealstream.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(target)
    # Stateful streams first start a Python worker beside the driver, which sees the search
    # path of the environment but not the added files.
    paths = [context.environment.get("PYTHONPATH", ""), str(root.parent)]
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    _shipped.add(context.applicationId)
