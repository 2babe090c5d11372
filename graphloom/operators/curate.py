"""Curation as functions from tables to tables (ids of the blueprint in brackets)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import udfs
from graphloom.functions.text import uuid5
from graphloom.operators.candidates import merge_groups

PARTS = 64
EDITABLE = ("canonical_name", "candidate_type", "description", "aliases", "confidence_score")


def set_status(rows: DataFrame, chosen: DataFrame, status: str, key: str = "candidate_key") -> DataFrame:
    """[C2, C8] Rows of `chosen` get the status."""
    hit = chosen.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def edit(rows: DataFrame, candidate_key: str, **changes) -> DataFrame:
    """[C2] Only fields that may be edited."""
    if odd := set(changes) - set(EDITABLE):
        raise ValueError(f"not editable: {sorted(odd)}")
    return reduce(lambda df, kv: df.withColumn(kv[0], F.when(F.col("candidate_key") == candidate_key, F.lit(kv[1])).otherwise(F.col(kv[0]))), changes.items(), rows)


def entities_of(approved: DataFrame) -> DataFrame:
    """[C1] Entities with deterministic ids."""
    return approved.select(uuid5(F.concat(F.lit("entity:"), "candidate_key")).alias("id"), "candidate_key", "canonical_name", F.col("candidate_type").alias("entity_type"), "confidence_score", "aliases", "chunk_ids", F.lit("approved").alias("status"))


def normalization_entries(entities: DataFrame) -> DataFrame:
    """[C1, T33] raw_text, canonical_id, canonical_name, method: the name and each alias."""
    return entities.select(F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("raw"), "id", "canonical_name").select(F.lower(F.trim("raw")).alias("raw_text"), F.col("id").alias("canonical_id"), "canonical_name", F.lit("approval").alias("method"), F.lit("approved").alias("status")).dropDuplicates(["raw_text"])


def approve(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """[C1] (candidates, entities, normalisation entries) after approving `chosen` (candidate_key)."""
    entities = entities_of(rows.join(chosen.select("candidate_key").distinct(), "candidate_key", "left_semi"))
    return set_status(rows, chosen, "approved"), entities, normalization_entries(entities)


def promote(relationships: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[J1, C4, C7] (edges, relationship candidates): pending candidates whose ends both resolve become edges.

    relationships: candidate_key, source, target, type, confidence_score, status; table: raw_text, canonical_id, status.
    """
    t = table.filter("status = 'approved' and canonical_id is not null").select("raw_text", "canonical_id").dropDuplicates(["raw_text"])
    ends = relationships.filter("status = 'pending'").withColumn("s", F.lower(F.trim("source"))).withColumn("t", F.lower(F.trim("target")))
    met = ends.join(t.select(F.col("raw_text").alias("s"), F.col("canonical_id").alias("src")), "s").join(t.select(F.col("raw_text").alias("t"), F.col("canonical_id").alias("dst")), "t").filter("src <> dst")
    edges = met.select(uuid5(F.concat_ws(":", F.lit("relationship"), "src", "type", "dst")).alias("edge_id"), "src", "dst", "type", "confidence_score", "candidate_key")
    one = edges.groupBy("edge_id", "src", "dst", "type").agg(F.max("confidence_score").alias("confidence_score"))
    return one, set_status(relationships, edges, "approved")


def merge(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """[C3, C6] groups: candidate_key, group. The survivor is approved with the merged values, the others are rejected."""
    merged = merge_groups(rows, groups).withColumn("status", F.lit("approved"))
    rest = rows.join(merged.select("candidate_key"), "candidate_key", "left_anti")
    return set_status(rest, groups, "rejected").select("candidate_key", "canonical_name", "candidate_type", "confidence_score", "mention_count", "aliases", "description", "status").unionByName(merged)


def merge_into_entity(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """[C3]"""
    return set_status(rows, chosen, "merged_into_entity")


def batch_approve(rows: DataFrame, least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """[C6] (candidates, what was approved): pending rows at or above `least`; 0.0 means all of them."""
    chosen = rows.filter((F.col("status") == "pending") & (F.col("confidence_score") >= least))
    return set_status(rows, chosen, "approved"), chosen


def upsert_normalization(old: DataFrame, new: DataFrame) -> DataFrame:
    """[T33] By raw_text; a changed row's version goes up by one."""
    both = old.select("raw_text", F.col("version").alias("v")).join(new, "raw_text", "full_outer")
    changed = both.filter("canonical_id is not null").withColumn("version", F.coalesce("v", F.lit(0)) + 1).drop("v")
    return old.join(new.select("raw_text"), "raw_text", "left_anti").unionByName(changed, allowMissingColumns=True)


def compare(pairs: DataFrame) -> DataFrame:
    """[A24, J16] pairs of structs a, b: shared aliases, type match, primary (more confident, tie a), merged preview."""
    first = F.col("a.confidence_score") >= F.col("b.confidence_score")
    name = lambda yes: F.when(yes, F.col("a.canonical_name")).otherwise(F.col("b.canonical_name"))
    return pairs.select(
        F.col("a.candidate_key").alias("a_key"), F.col("b.candidate_key").alias("b_key"),
        F.size(F.array_intersect("a.aliases", "b.aliases")).alias("shared_aliases"), (F.col("a.candidate_type") == F.col("b.candidate_type")).alias("same_type"),
        name(first).alias("primary_name"), F.array_sort(F.array_union("a.aliases", "b.aliases")).alias("merged_aliases"), (F.col("a.mention_count") + F.col("b.mention_count")).alias("mention_count"), F.greatest("a.confidence_score", "b.confidence_score").alias("confidence_score"),
    )


def duplicate_suggestions(wanted: DataFrame, rows: DataFrame, k: int = 5, least: float = 0.7, score=udfs.lcs_similarity, hints: DataFrame | None = None) -> DataFrame:
    """[J16] source, target, score, reason, rank: the k likeliest duplicates of each wanted candidate_key among all rows.

    A shared alias scores 1, a name among the other's aliases 0.9, an embedding hint (source, target, score) its own score,
    names at least as alike as `least` their ratio; the best reason counts. Rows of one name and the same aliases fare alike:
    each such profile is compared once, with its k + 1 least keys (one may be the source). Each wanted profile meets PARTS
    parts of the others, in tasks of their own.
    """
    none = F.array().cast("array<string>")
    low = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(x))))
    named = rows.select("candidate_key", F.lower("canonical_name").alias("name"), low("aliases").alias("aliases"))
    profile = lambda df: df.select(F.struct("name", "aliases").alias("p"), "candidate_key").distinct()
    first = profile(named).withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("candidate_key"))).filter(F.col("r") <= k + 1)
    b = first.groupBy("p").agg(F.array_sort(F.collect_list("candidate_key")).alias("keys")).withColumn("part", F.pmod(F.xxhash64("p"), F.lit(PARTS)).cast("int"))
    own = profile(named.join(wanted.select("candidate_key").distinct(), "candidate_key", "left_semi")).select(F.col("candidate_key").alias("source"), "p")
    a = own.select("p").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = a.select(F.col("p").alias("q"), "part").repartition(PARTS, "part").join(b.repartition(PARTS, "part"), "part")
    shared = F.arrays_overlap("q.aliases", "p.aliases")
    inside = F.array_contains("p.aliases", F.col("q.name")) | F.array_contains("q.aliases", F.col("p.name"))
    found = met.select("q", "keys", shared.alias("_s"), inside.alias("_i"), score(F.col("q.name"), F.col("p.name")).alias("_r"))
    reason = F.when(F.col("_s"), "shared_alias").when(F.col("_i"), "alias_match").when(F.col("_r") > least, "similar_name")
    alike = found.withColumn("reason", reason).filter("reason is not null").select("q", "keys", F.when(F.col("_s"), 1.0).when(F.col("_i"), 0.9).otherwise(F.col("_r")).alias("score"), "reason")
    near = alike.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.round("score", 9).desc(), F.get("keys", F.lit(0))))).filter(F.col("r") <= k + 1)
    each = near.select("q", "score", "reason", F.explode("keys").alias("target"))
    lists = each.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.round("score", 9).desc(), "target"))).filter(F.col("r") <= k + 1).select(F.col("q").alias("p"), "score", "reason", "target")
    hits = own.join(lists, "p").filter("source <> target").select("source", "target", "score", "reason")
    if hints is not None:
        hits = hits.unionByName(hints.join(wanted.select(F.col("candidate_key").alias("source")).distinct(), "source", "left_semi").select("source", "target", "score", F.lit("embedding").alias("reason")))
    best = hits.groupBy("source", "target").agg(F.max(F.struct("score", "reason")).alias("m")).select("source", "target", "m.score", "m.reason")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.round("score", 9).desc(), "target"))).filter(F.col("rank") <= k)


def preview_merge(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """[C6] What merge() would make of each group, without changing anything: the merged row, and how many go into it."""
    return merge_groups(rows, groups).join(groups.join(rows.select("candidate_key"), "candidate_key").groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.collect_set("candidate_key").alias("_k")), F.array_contains("_k", F.col("candidate_key"))).drop("_k", "group")
