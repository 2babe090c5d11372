"""From documents to token files: quality rules, near-duplicates, decontamination, mixing, token blocks.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; the last one returns what it reads back from the
token files. Mixing repeats a document that the mix takes twice, so the last stage may return a doc_id twice.

Decisions: quality_rules drops the documents that it rejects and takes failing lines out of the others; near_duplicates
keeps one document of each group; decontamination drops what holds a benchmark window; source_mix drops and repeats.
Defined cases: a null or empty text is rejected by the first stage; rows that share an id are one document for
near_duplicates, of which one row stays, and of rows with a null id one of each set of shingles; a null source is a
source of its own; a text of any length is processed whole; ties are settled by the smallest id, then by the text; more
columns than those of documents travel along to the last stage; an empty table passes every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontam, minhash, mixing, quality, tokens
from graphloom.llm.queries import vocabulary
from graphloom.session import ready_workers, table, write_shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs, length="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies(mixing.mix(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder, manifest = tokens.write_tokens(docs, vocabulary())
    return tokens.read_tokens(folder, manifest)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

# SQL can't express the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready_workers(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
