"""Makes the package importable by Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

_done: set[str] = set()


def ship(spark) -> None:
    """Send the package's sources to the workers, once an application, unless their path has them already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _done or root in map(os.path.abspath, filter(None, paths)) or os.path.realpath(os.getcwd()) == os.path.realpath(root):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lichenmill-"), "lichenmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "lichenmill")):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.relpath(at, root))
    spark.sparkContext.addPyFile(archive)
    _done.add(app)
