"""File sources (ids of the blueprint in brackets): discovery, text and Markdown, sections, metadata, PDF hook, history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import date_of, pdf_date, uuid5, version_of

SUFFIXES = (".pdf", ".txt", ".md", ".markdown")


def find_files(spark: SparkSession, paths: list[str], include_text: bool = True) -> DataFrame:
    """[SRC1] path, length, modificationTime of documents below the paths, each once, in order. Contents are not read."""
    kinds = SUFFIXES if include_text else SUFFIXES[:1]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    return found.filter(F.lower("path").rlike("(" + "|".join(k.replace(".", r"\.") for k in kinds) + ")$")).distinct().orderBy("path")


def read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """[SRC2, SRC8] path, filename, content, title, checksum, document_id, source_type; bytes that are no UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).filter(F.lower("path").rlike(r"\.(txt|md|markdown)$"))
    rows = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("checksum"))
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    heading = F.nullif(F.regexp_extract("content", r"(?m)^# +(.+?)\s*$", 1), F.lit(""))
    first = F.nullif(F.trim(F.regexp_extract("content", r"(?m)^\s*(\S.*)$", 1)), F.lit(""))
    return rows.withColumn("title", F.substring(F.coalesce(heading, first, stem), 1, 200)).withColumn("document_id", uuid5(F.col("checksum"))).withColumn("source_type", F.when(F.col("path").rlike(r"\.txt$"), "text").otherwise("markdown"))


def sections(docs: DataFrame, doc_id: str = "document_id") -> DataFrame:
    """[SRC3, W13] doc_id, section, subsection (0: the section itself), title, content, of Markdown.

    "# " opens a section, "## " a subsection; a subsection before any section opens one named by the stem. Deeper
    headings are content; text before any heading is left out; plain text has no sections.
    """
    lines = docs.filter("source_type = 'markdown'").select(doc_id, F.regexp_replace("filename", r"\.[^.]+$", "").alias("stem"), F.posexplode(F.split("content", r"\r?\n")).alias("n", "line"))
    w = W.partitionBy(doc_id).orderBy("n")
    h1, h2 = F.col("line").rlike(r"^# "), F.col("line").rlike(r"^## ")
    marked = lines.withColumn("h1", h1.cast("int")).withColumn("h2", h2.cast("int"))
    marked = marked.withColumn("orphan", (F.col("h2") == 1) & (F.coalesce(F.sum("h1").over(w), F.lit(0)) == 0) & (F.sum("h2").over(w) == 1))
    marked = marked.withColumn("section", F.sum(F.col("h1") + F.col("orphan").cast("int")).over(w)).filter("section > 0")
    marked = marked.withColumn("subsection", F.sum("h2").over(W.partitionBy(doc_id, "section").orderBy("n")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("h1") == 0) & (F.col("h2") == 0), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    title = F.max(F.when((F.col("h1") == 1) | (F.col("h2") == 1), F.regexp_replace("line", r"^#+ +", "")))
    out = marked.groupBy(doc_id, "section", "subsection").agg(title.alias("title"), F.first("stem").alias("stem"), F.trim(body).alias("content"))
    return out.select(doc_id, "section", "subsection", F.coalesce("title", "stem").alias("title"), "content")


def metadata(docs: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """[SRC6, SRC7] Adds size, version, date, from the document's information (path, title, created) or from its text."""
    out = docs.withColumn("size", F.octet_length("content")).withColumn("version", version_of(F.col("content"))).withColumn("date", date_of(F.col("content")))
    if info is None:
        return out
    met = out.join(info.select("path", F.col("title").alias("_t"), F.col("created").alias("_c")), "path", "left")
    return met.withColumn("title", F.coalesce(F.nullif(F.trim("_t"), F.lit("")), "title")).withColumn("date", F.coalesce(pdf_date(F.col("_c")), "date")).drop("_t", "_c")


def read_pdf(spark: SparkSession, paths: list[str], parse: Callable[[bytes], str] | None = None, stop_after: int = 5) -> DataFrame:
    """[SRC4] path, content, error. `parse` turns bytes into text; without one, or where it fails, the row holds the error.

    A partition gives up after stop_after failures in a row, as a broken batch would fail on.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for pdf in parts:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                if failed >= stop_after:
                    out.append((path, None, "skipped after repeated errors"))
                    continue
                try:
                    if parse is None:
                        raise RuntimeError("no PDF parser given")
                    out.append((path, parse(bytes(data)), None))
                    failed = 0
                except Exception as error:
                    failed += 1
                    out.append((path, None, str(error)))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(paths)
    return rows.select("path", "content").mapInPandas(run, "path string, content string, error string")


def labelled_items(items: DataFrame, doc_id: str = "document_id") -> DataFrame:
    """[SRC5] Items (n, label, text, page) of a parsed page flow to sections, tables and figures by running heading counts."""
    w = W.partitionBy(doc_id).orderBy("n")
    marked = items.withColumn("section", F.sum((F.col("label") == "heading").cast("int")).over(w))
    for kind in ("table", "figure"):
        marked = marked.withColumn(f"{kind}_id", F.when(F.col("label") == kind, F.concat(F.lit(f"{kind}_"), F.sum((F.col("label") == kind).cast("int")).over(w).cast("string"))))
    return marked


def read_history(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """[SRC11] Logged questions, newest first."""
    rows = spark.read.json(path).orderBy(F.desc("timestamp"), F.desc("query_id"))
    return rows if most is None else rows.limit(most)
