"""The registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, dealt to all of them; any other as it is.

    A file may be one row group, which only one task can read. What is moved is under SPREAD_BYTES for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= cores * SPREAD_BYTES and 1 <= len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
