"""Incremental work: change detection, checkpoints, stream upserts (ids of the blueprint in brackets)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import candidates


def detect_changes(stored: DataFrame, disk: DataFrame, roots: list[str]) -> DataFrame:
    """[I1, F12, J12, J13] path, checksum, document_id, status: new, modified, unchanged or deleted.

    A file matches by path, else by name and checksum (it moved). stored: document_id, path, filename, checksum.
    """
    here = disk.select("path", "filename", "checksum")
    by_path = here.join(stored.select("path", F.col("document_id").alias("d1"), F.col("checksum").alias("c1")), "path", "left")
    moved = stored.groupBy("filename", "checksum").agg(F.min("document_id").alias("d2"))
    met = by_path.join(moved, ["filename", "checksum"], "left")
    status = F.when(F.col("d1").isNotNull() & (F.col("c1") == F.col("checksum")), "unchanged").when(F.col("d1").isNotNull(), "modified").when(F.col("d2").isNotNull(), "unchanged").otherwise("new")
    found = met.select("path", "checksum", F.coalesce("d1", "d2").alias("document_id"), status.alias("status"))
    scope = reduce(or_, [(F.col("path") == r) | F.col("path").startswith(r.rstrip("/") + "/") for r in roots])
    claimed = found.filter("document_id is not null").select("document_id").distinct()
    gone = stored.filter(scope).join(claimed, "document_id", "left_anti").join(here.select("path"), "path", "left_anti")
    return found.unionByName(gone.select("path", "checksum", "document_id", F.lit("deleted").alias("status")))


def report_counts(report: DataFrame) -> DataFrame:
    """[A23]"""
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def apply_report(documents: DataFrame, chunks: DataFrame, report: DataFrame, new_documents: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[I2] Deleted and modified documents leave with their chunks, then what was read anew comes in."""
    out = report.filter("status in ('deleted', 'modified')").select("document_id").distinct()
    return documents.join(out, "document_id", "left_anti").unionByName(new_documents), chunks.join(out, "document_id", "left_anti").unionByName(new_chunks)


def to_process(documents: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """[I3] Documents without a completed run of the same checksum."""
    return documents.join(done.filter("status = 'completed'").select(key, "checksum"), [key, "checksum"], "left_anti")


def upsert_stream(mentions: DataFrame, store: str, checkpoint: str):
    """[I5] A stream of mentions merged into the candidate table at `store`, one version a micro-batch.

    A batch that runs again writes the same version again, so the table is exact after a failure.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = candidates.aggregate(batch)
        if number:
            fresh = candidates.upsert(spark.read.parquet(f"{store}/v{number - 1}"), fresh)
        fresh.write.mode("overwrite").parquet(f"{store}/v{number}")

    return mentions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extra of ours: counts and sums of events by type in tumbling windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
