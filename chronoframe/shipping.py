"""Make this package importable where tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless their path has it already.

    Workers get the PYTHONPATH and, on one machine, the working folder of the driver; where neither is the repository's, as
    when it was put on sys.path by hand, Spark's file server delivers a zip.
    """
    here = {os.path.realpath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()]}
    app = spark.sparkContext.applicationId
    if str(ROOT) in here or app in _SHIPPED or str(ROOT).endswith(".zip"):
        return
    path = Path(tempfile.mkdtemp(prefix="chronoframe-code-")) / "chronoframe.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "chronoframe").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
