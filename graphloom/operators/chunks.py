"""The four-level chunk hierarchy (ids of the blueprint in brackets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import paragraphs, sentences, token_estimate, uuid5

MAX_TOKENS = 512
CARRY = 2  # sentences that the next chunk repeats


def pack(units: Column, most: int = MAX_TOKENS) -> Column:
    """[W12] Sentences (array of struct s, t) to chunks: a fold that flushes before the budget breaks and carries the last two on.

    A sentence after a flush is added without a second check, so a chunk may exceed the budget.
    """
    item = "struct<s:string,t:int>"
    start = F.struct(F.array().cast(f"array<array<{item}>>").alias("done"), F.array().cast(f"array<{item}>").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] + x["t"] > most) & (F.size(acc["now"]) > 0)
        carried = F.slice(acc["now"], F.greatest(F.size(acc["now"]) - (CARRY - 1), F.lit(1)), F.lit(CARRY))
        base = F.when(full, carried).otherwise(acc["now"])
        n = F.when(full, F.aggregate(carried, F.lit(0), lambda a, y: a + y["t"])).otherwise(acc["n"])
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.array_append(base, x).alias("now"), (n + x["t"]).cast("int").alias("n"))

    finish = lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
    return F.aggregate(units, start, step, finish)


def sentence_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MAX_TOKENS) -> DataFrame:
    """[T8, W12] doc_id, n, content, token_count: a text's sentences packed into chunks."""
    units = F.transform(sentences(F.col(text)), lambda s: F.struct(s.alias("s"), token_estimate(s).alias("t")))
    packed = docs.select(doc_id, F.posexplode(pack(units, most)).alias("n", "c"))
    return packed.select(doc_id, "n", F.array_join(F.transform("c", lambda x: x["s"]), " ").alias("content"), F.aggregate("c", F.lit(0), lambda a, x: a + x["t"]).alias("token_count"))


def hierarchy(docs: DataFrame, sections: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", most: int = MAX_TOKENS) -> DataFrame:
    """[T10] Levels 1 (document), 2 (section), 3 (subsection) and 4 (paragraph, split where too long), with paths and parents.

    sections: doc_id, section, subsection (0 for a section itself), content. A section that has subsections gives no
    paragraphs of its own; a document without sections gives its paragraphs directly.
    """
    cid = lambda d, path: uuid5(F.concat_ws("|", d.cast("string"), path))
    d = F.col(doc_id)
    top = docs.select(d.alias("document_id"), F.lit(1).alias("level"), F.lit("1").alias("path"), F.lit(None).cast("string").alias("parent"), F.col(text).alias("content"))
    leaves = top
    out = top
    if sections is not None:
        path = F.when(F.col("subsection") == 0, F.concat(F.lit("1."), F.col("section").cast("string"))).otherwise(F.concat_ws(".", F.lit("1"), F.col("section").cast("string"), F.col("subsection").cast("string")))
        s = sections.select(d.alias("document_id"), F.when(F.col("subsection") == 0, 2).otherwise(3).alias("level"), path.alias("path"), F.when(F.col("subsection") == 0, F.lit("1")).otherwise(F.concat(F.lit("1."), F.col("section").cast("string"))).alias("parent"), "content")
        inner = s.filter("level = 3").select("document_id", F.col("parent").alias("path")).distinct()
        whole = top.join(s.select("document_id").distinct(), "document_id", "left_anti")
        leaves = whole.unionByName(s.join(inner, ["document_id", "path"], "left_anti").select(*s.columns))
        out = top.unionByName(s)
    para = leaves.select("document_id", F.col("path").alias("parent"), F.posexplode(paragraphs(F.col("content"))).alias("i", "p"))
    units = F.transform(sentences(F.col("p")), lambda x: F.struct(x.alias("s"), token_estimate(x).alias("t")))
    long = token_estimate(F.col("p")) > most
    pieces = F.when(long, F.transform(pack(units, most), lambda c: F.array_join(F.transform(c, lambda x: x["s"]), " "))).otherwise(F.array("p"))
    split = para.select("document_id", "parent", "i", long.alias("long"), F.posexplode(pieces).alias("j", "content"))
    path4 = F.concat_ws(".", "parent", (F.col("i") + 1).cast("string"), F.when(F.col("long"), (F.col("j") + 1).cast("string")))
    fourth = split.select("document_id", F.lit(4).alias("level"), path4.alias("path"), "parent", "content")
    every = out.unionByName(fourth)
    return every.select(cid(F.col("document_id"), F.col("path")).alias("chunk_id"), "document_id", "level", "path", F.when(F.col("parent").isNotNull(), cid(F.col("document_id"), F.col("parent"))).alias("parent_chunk_id"), "content", token_estimate(F.col("content")).alias("token_count"))


def statistics(chunks: DataFrame) -> DataFrame:
    """[A15] level, n, least, most, total and mean of the tokens."""
    return chunks.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.sum("token_count").alias("total"), F.avg("token_count").alias("mean"))


def of_document(chunks: DataFrame, document_id, level: int | None = None) -> DataFrame:
    """[G19] In order of level, path (as strings)."""
    rows = chunks.filter(F.col("document_id") == document_id)
    return (rows if level is None else rows.filter(F.col("level") == level)).orderBy("level", "path")


def mentioning(chunks: DataFrame, entity_ids: list[str], most: int | None = 100) -> DataFrame:
    """[F13, H3] In order of level, path; None takes all, in no order."""
    found = chunks.filter(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entity_ids)))).dropDuplicates(["chunk_id"])
    return found if most is None else found.orderBy("level", "path").limit(most)


def fetch(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """[J5] The chunks whose id is asked for, each once however often it is asked; Spark chooses how to join by size."""
    return chunks.join(ids.select(key).distinct(), key, "left_semi")
