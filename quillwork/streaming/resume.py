"""Resumable work: committed batches, and a stream of results with one retry (R-4 to R-6, R-16, K-9)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillwork.operators.contracts import ContractError, require_empty
from quillwork.sources.publish import _fs, read_text, write_text


def digest(contract: dict) -> str:
    """N-6: SHA-256 of the JSON with sorted keys."""
    return hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class BatchStore:
    """A folder of batches, each a Parquet table and then a marker, bound to one contract.

    The marker is the commit: a batch without one is written again. A folder of another contract is an error, and so
    is a second commit of a batch, or a row outside the batch's ids.
    """

    def __init__(self, spark: SparkSession, root: str, contract: dict) -> None:
        self.spark, self.root, self.binding = spark, root.rstrip("/"), digest(contract)
        fs, path = _fs(spark, f"{self.root}/_CONTRACT")
        if fs.exists(path):
            if read_text(spark, f"{self.root}/_CONTRACT") != self.binding:
                raise ContractError("the store is bound to another contract")
        else:
            write_text(spark, f"{self.root}/_CONTRACT", self.binding)

    def committed(self, batch: int) -> bool:
        fs, path = _fs(self.spark, f"{self.root}/done/{batch}")
        return fs.exists(path)

    def commit(self, batch: int, ids: DataFrame, rows: DataFrame, key: str = "event_id") -> None:
        """Stores a batch's rows; ids that have none are stored too, as measured zero."""
        if self.committed(batch):
            raise ContractError(f"batch {batch} is committed")
        require_empty(rows.join(ids, key, "left_anti"), "rows outside the batch")
        require_empty(rows.groupBy(key).count().filter("count > 1"), "a key repeats")
        numbers = [c for c, t in rows.dtypes if c != key and t in ("int", "bigint")]
        ids.select(key).distinct().join(rows, key, "left").fillna(0, numbers).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        write_text(self.spark, f"{self.root}/done/{batch}", self.binding)

    def run(self, batches: DataFrame, work: Callable[[DataFrame], DataFrame], key: str = "event_id") -> int:
        """R-4, R-6: does the batches (key, batch_id) that aren't committed; how many it did.

        A batch is a job and a commit of its own, so that a run that dies loses one; the number of batches is the
        caller's choice, and only their numbers come to the driver.
        """
        done = self.done_batches()
        wanted = [r.batch_id for r in batches.select("batch_id").distinct().orderBy("batch_id").toLocalIterator() if r.batch_id not in done]
        for number in wanted:
            ids = batches.filter(F.col("batch_id") == number).select(key)
            self.commit(number, ids, work(ids), key)
        return len(wanted)

    def done_batches(self) -> set[int]:
        """The numbers of the committed batches, from one listing of the markers."""
        fs, folder = _fs(self.spark, f"{self.root}/done")
        return {int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()} if fs.exists(folder) else set()

    def materialise(self, batches: DataFrame, key: str = "event_id") -> DataFrame:
        """R-16: all rows, once every batch is committed."""
        wanted = {r.batch_id for r in batches.select("batch_id").distinct().toLocalIterator()}
        if missing := wanted - self.done_batches():
            raise ContractError(f"batches are missing: {sorted(missing)[:5]}")
        every = self.spark.read.option("basePath", self.root).parquet(f"{self.root}/batch=*")
        return every.join(F.broadcast(batches.select(F.col("batch_id").alias("batch")).distinct()), "batch", "left_semi").drop("batch")  # partitions are pruned by it


def append_results(source: DataFrame, path: str, checkpoint: str, key: str = "custom_id", max_attempts: int = 2) -> StreamingQuery:
    """K-9: a stream of result rows to an append-only Parquet log, at most ``max_attempts`` rows for each id.

    Rows of an id within a micro-batch are numbered, in the order of all their columns, on from those of the batches
    before. A micro-batch is written under its number, and written over if it is run again, so each row is there once.
    Beside it stand the counts by id after it, so that a batch reads the counts of the one before and not the whole log;
    counts of two batches before and earlier go.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, folder = _fs(spark, f"{path}.counts")
        epochs = sorted(int(s.getPath().getName().removeprefix("epoch=")) for s in fs.listStatus(folder) if s.getPath().getName().startswith("epoch=")) if fs.exists(folder) else []
        earlier = [e for e in epochs if e < number]
        order = Window.partitionBy(key).orderBy(*[F.col(c) for c in batch.columns if c != key], F.lit(0))
        numbered = batch.withColumn("__number", F.row_number().over(order))
        seen = spark.read.parquet(f"{path}.counts/epoch={earlier[-1]}") if earlier else batch.select(key, F.lit(0).cast("long").alias("__seen")).limit(0)
        kept = numbered.join(seen, key, "left").filter(F.coalesce("__seen", F.lit(0)) + F.col("__number") <= max_attempts).select(*batch.columns)
        kept.write.mode("overwrite").parquet(f"{path}/epoch={number}")
        added = spark.read.schema(batch.schema).parquet(f"{path}/epoch={number}").groupBy(key).agg(F.count("*").alias("__seen"))
        seen.unionByName(added).groupBy(key).agg(F.sum("__seen").alias("__seen")).write.mode("overwrite").parquet(f"{path}.counts/epoch={number}")
        for e in earlier[:-1]:
            fs.delete(_fs(spark, f"{path}.counts/epoch={e}")[1], True)

    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log, with the epoch that brought them."""
    return spark.read.parquet(path)
