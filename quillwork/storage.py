"""Written tables in the folder that the cluster shares, to cut lineage and to outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # by application, where the setting is unset
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a new local folder on a single machine (as in
    tests), and an error on a cluster, whose executors couldn't see it."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillwork-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillwork/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, without lineage."""
    return written_in_parts([df], name, **options)


def written_in_parts(parts: list[DataFrame], name: str, **options: str) -> DataFrame:
    """As ``written``, of tables of one schema: a job for each, so that no plan and no stage holds all of them."""
    spark = parts[0].sparkSession
    path = new_path(spark, name)
    for df in parts:
        df.write.options(**options).mode("append").parquet(path)
    table = spark.read.schema(parts[0].schema).parquet(path)
    table._quillwork_path = path
    if _scopes:
        _scopes[-1].append(table)
    return table


def remove(table: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._quillwork_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def only_kept(keep: list[DataFrame]) -> Iterator[None]:
    """Deletes the tables that are ``written`` inside, but for those that stand in ``keep`` at the end."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for table in made:
            if not any(table is k for k in keep):
                remove(table)
