"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED, _BEFORE = "_quillwork_shipped", "_quillwork_settings"

#: Rows are texts of up to megabytes: batches are bounded so that a task holds a few MB of them at a time.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def build(app: str = "quillwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are tested with: UTC, adaptive execution, ANSI mode."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound(spark: SparkSession) -> None:
    """Bounds the session's batches, for operators on whole texts; ``release`` gives the caller's settings back."""
    before = spark.__dict__.setdefault(_BEFORE, {})
    for key, value in BATCHES.items():
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)


def release(spark: SparkSession) -> None:
    for key, value in spark.__dict__.pop(_BEFORE, {}).items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that it needn't be installed on them."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        folder = tempfile.mkdtemp(prefix="quillwork-")  # the driver's own; addPyFile sends it
        atexit.register(shutil.rmtree, folder, True)
        archive = Path(folder) / "quillwork.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent).as_posix())
        context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)
