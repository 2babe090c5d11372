"""Command line [H5, §2.13]: python -m graphloom ingest|discover|query|update STORE ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.udfs import hashed_embedding
from graphloom.operators import chunks, discover, extract, vector
from graphloom.operators.components import components
from graphloom.plans.retrieval import parse
from graphloom.sources import files, sinks
from graphloom.streaming import updates


def _read(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store}/{name}")


def ingest(spark: SparkSession, store: str, paths: list[str]) -> dict:
    """Files to documents, chunks and chunk vectors."""
    docs = files.metadata(files.read_text(spark, paths))
    docs.write.mode("overwrite").parquet(f"{store}/documents")
    docs = _read(spark, store, "documents")
    cut = chunks.hierarchy(docs.withColumnRenamed("document_id", "doc_id"), files.sections(docs).withColumnRenamed("document_id", "doc_id"), text="content")
    cut.write.mode("overwrite").parquet(f"{store}/chunks")
    cut = _read(spark, store, "chunks")
    hashed_embedding()(cut.select(F.col("chunk_id").alias("key"), F.col("content").alias("text"))).write.mode("overwrite").parquet(f"{store}/vectors")
    extract.relationships(cut.filter("level = 4 or level = 2").select("chunk_id", "document_id", F.col("content").alias("text"))).drop("text").write.mode("overwrite").parquet(f"{store}/relationships")
    return {"documents": docs.count(), "chunks": cut.count()}


def update(spark: SparkSession, store: str, paths: list[str], roots: list[str]) -> dict:
    """What changed since the last ingestion."""
    old = _read(spark, store, "documents").select("document_id", "path", "filename", "checksum")
    return {r.status: r.n for r in updates.report_counts(updates.detect_changes(old, files.read_text(spark, paths).select("path", "filename", "checksum"), roots)).collect()}


def discover_report(spark: SparkSession, store: str, form: str) -> str:
    """Co-occurrence of the names in relationships, by chunk."""
    r = _read(spark, store, "relationships")
    m = r.select("chunk_id", F.explode(F.array(F.lower("source"), F.lower("target"))).alias("key")).withColumn("confidence", F.lit(0.8)).withColumn("mention_count", F.lit(1))
    edges = discover.cooccurrence(m, 1)
    return sinks.report({"edges": edges, "clusters": discover.clusters(edges, components, 1)}, form)


def query(spark: SparkSession, store: str, question: str, k: int) -> dict:
    """The parsed question and its best chunks."""
    q = parse(spark.createDataFrame([(question,)], "q string"))
    asked = hashed_embedding()(q.select(F.col("query_id").alias("key"), F.col("q").alias("text"))).withColumnRenamed("key", "query_id")
    hits = vector.top_k(asked, _read(spark, store, "vectors").withColumnRenamed("key", "point_id"), k, 0.0, exclude_self=False)
    found = hits.join(_read(spark, store, "chunks"), F.col("point_id") == F.col("chunk_id")).orderBy("rank")
    r = q.select("query_id", "intent", "relationship_types", "strategy", "max_depth").first()
    rows = [{"rank": x.rank, "score": round(x.score, 4), "chunk": x.chunk_id, "text": x.content[:300]} for x in found.collect()]  # at most k
    return {"question": r.asDict(), "hits": rows}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("command", choices=("ingest", "discover", "query", "update"))
    p.add_argument("store")
    p.add_argument("args", nargs="*")
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--form", choices=("json", "markdown", "html"), default="json")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "ingest":
        print(json.dumps(ingest(spark, a.store, a.args)))
    elif a.command == "update":
        print(json.dumps(update(spark, a.store, a.args, a.args)))
    elif a.command == "discover":
        print(discover_report(spark, a.store, a.form))
    else:
        print(json.dumps(query(spark, a.store, " ".join(a.args), a.top), ensure_ascii=False, indent=1))


if __name__ == "__main__":
    main()
