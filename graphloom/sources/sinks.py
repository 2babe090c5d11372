"""Sinks (ids of the blueprint in brackets): normalisation and acronym tables, reports, logs, catalogue, snapshots."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.discover import dot_edges, matrix_cells


def write_normalization(table: DataFrame, path: str, form: str = "json") -> None:
    """[SNK5] JSON, or CSV with variants joined by " | " and three places of confidence."""
    if form == "json":
        table.write.mode("overwrite").json(path)
        return
    flat = table.withColumn("variants", F.array_join("variants", " | ")).withColumn("confidence", F.format_string("%.3f", "confidence"))
    flat.write.mode("overwrite").option("header", "true").csv(path)


def read_normalization(spark: SparkSession, path: str, form: str = "json", schema: str = "raw_text string, canonical_id string, canonical_name string, variants array<string>, confidence double, version int") -> DataFrame:
    if form == "json":
        return spark.read.schema(schema).json(path)
    rows = spark.read.option("header", "true").csv(path)
    return rows.withColumn("variants", F.filter(F.split("variants", r" \| "), lambda v: v != "")).withColumn("confidence", F.col("confidence").cast("double")).withColumn("version", F.col("version").cast("int"))


def write_acronyms(table: DataFrame, path: str) -> None:
    """[SNK6] acronym, expansion, n, contexts as Parquet."""
    table.write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """[SNK11, SNK12] Audit events or questions, appended as JSON lines."""
    rows.write.mode("append").json(path)


def dot(edges: DataFrame, most: int = 75) -> str:
    """[SNK8] Graphviz text of the edges between at most `most` nodes."""
    quote = lambda x: json.dumps(str(x), ensure_ascii=False)
    rows = dot_edges(edges, most).orderBy("left", "right").collect()  # at most most * (most - 1) / 2
    return "\n".join(["graph cooccurrence {", *(f"  {quote(r.left)} -- {quote(r.right)} [label={r.n}, penwidth={r.penwidth:.2f}];" for r in rows), "}"])


def matrix(edges: DataFrame, most: int = 100) -> DataFrame:
    """[SNK9] The symmetric matrix as a table: a row and a column a node."""
    return matrix_cells(edges, most).withColumn("column", F.col("column").cast("string")).groupBy("row").pivot("column").agg(F.sum("n")).fillna(0).orderBy("row")


def report(parts: dict[str, DataFrame], form: str = "json", most: int = 500) -> str:
    """[SNK7] Named small tables as JSON, Markdown or HTML, at most `most` rows each (a report, not an export)."""
    data = {name: [r.asDict(recursive=True) for r in df.limit(most).collect()] for name, df in parts.items()}
    if form == "json":
        return json.dumps(data, default=str, ensure_ascii=False, indent=1)
    if form == "markdown":
        out = ["# Discovery report"]
        for name, rows in data.items():
            out += ["", f"## {name}", ""]
            if rows:
                out += ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(str(v) for v in r.values()) + " |" for r in rows)]
        return "\n".join(out)
    cell = lambda v, t: f"<{t}>{html.escape(str(v))}</{t}>"
    body = "".join(f"<h2>{html.escape(n)}</h2><table><tr>{''.join(cell(k, 'th') for k in (rows[0] if rows else ()))}</tr>{''.join('<tr>' + ''.join(cell(v, 'td') for v in r.values()) + '</tr>' for r in rows)}</table>" for n, rows in data.items())
    return f"<!DOCTYPE html><title>Discovery report</title><h1>Discovery report</h1>{body}"


def write_dataset(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """[SNK2, C5] One write a table below folder/v<version>; the version counts once its _DONE table is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/v{version}/_DONE_")


def read_dataset(spark: SparkSession, folder: str, version: int, names: list[str]) -> dict[str, DataFrame]:
    """[C5] A version's tables; undo and rollback read an earlier one."""
    return {n: spark.read.parquet(f"{folder}/v{version}/{n}") for n in names}


def create_tables(spark: SparkSession, database: str, schemas: dict[str, str], recreate: bool = False) -> list[str]:
    """[SNK13, SNK4] Creates tables that do not exist; returns all names. schemas: name to column definitions."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in schemas.items():
        if recreate:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return sorted(r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect())


def drop_all(spark: SparkSession, database: str) -> None:
    """[SNK4]"""
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


def embedding_cache(texts: DataFrame, cache: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """[SNK10, T30] (texts with vectors, new cache): each distinct text that the cache lacks is embedded once.

    texts: text; cache: key, vector; embed: a function from DataFrame(key, text) to DataFrame(key, vector).
    """
    keyed = texts.withColumn("key", F.md5("text"))
    fresh = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    full = cache.unionByName(embed(fresh).select("key", "vector"))
    return keyed.join(full, "key", "left"), full
