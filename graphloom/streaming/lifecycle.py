"""Documents' life cycle: ingesting, then completed or failed, with rollback (ids of the blueprint in brackets)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOG = "document_id string, checksum string, status string, error string, batch string, at timestamp"


class Ingestion:
    """[I4] Chunks by batch below `store`, and a log of statuses. Only chunks of batches that the log calls completed are read.

    A batch writes its chunks to a folder of its own first and its status last. If it fails, or the driver is lost, its
    folder counts for nothing, so a rollback never has to undo a write; roll_back() only frees the space.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def _log(self, documents: DataFrame, status: str, batch: str, error: str | None = None) -> None:
        rows = documents.select(F.col("document_id").cast("string"), "checksum", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.lit(batch).alias("batch"), F.current_timestamp().alias("at"))
        rows.write.mode("append").parquet(f"{self.store}/log")

    def statuses(self) -> DataFrame:
        """The latest status of each document."""
        if not self._there(f"{self.store}/log"):
            return self.spark.createDataFrame([], LOG)
        order = W.partitionBy("document_id").orderBy(F.desc("at"), F.desc(F.col("status") != "ingesting"))
        return self.spark.read.schema(LOG).parquet(f"{self.store}/log").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")

    def run(self, documents: DataFrame, make: Callable[[DataFrame], DataFrame]) -> dict:
        """Ingests what has no completed run of the same checksum. documents: document_id, checksum, ...; make gives chunks."""
        done = self.statuses().filter("status = 'completed'").select("document_id", "checksum")
        fresh = documents.withColumn("document_id", F.col("document_id").cast("string")).join(done, ["document_id", "checksum"], "left_anti")
        batch = uuid.uuid4().hex
        self._log(fresh, "ingesting", batch)
        try:
            chunks, counts = counted(make(fresh), "chunks", chunks=F.count(F.lit(1)))
            chunks.write.parquet(f"{self.store}/chunks/batch={batch}")
        except Exception as error:
            self.roll_back(batch)
            self._log(self._of(batch), "failed", batch, str(error)[:500])
            return {"batch": batch, "status": "failed", "error": str(error)[:500], "chunks": 0}
        self._log(self._of(batch), "completed", batch)
        return {"batch": batch, "status": "completed", "error": None, "chunks": counts.get["chunks"]}

    def _of(self, batch: str) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.store}/log").filter((F.col("batch") == batch) & (F.col("status") == "ingesting")).select("document_id", "checksum")

    def roll_back(self, batch: str) -> None:
        p, fs = self._path(f"{self.store}/chunks/batch={batch}")
        fs.delete(p, True)

    def chunks(self) -> DataFrame | None:
        """Chunks of each document's completed batch; None before the first."""
        if not self._there(f"{self.store}/chunks"):
            return None
        good = self.statuses().filter("status = 'completed'").select("document_id", "batch")
        rows = self.spark.read.parquet(f"{self.store}/chunks")
        return rows.withColumn("document_id", F.col("document_id").cast("string")).join(good, ["document_id", "batch"], "left_semi").drop("batch")


def counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """[A22] df, and counters that Spark fills while df runs, without a pass of their own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen
