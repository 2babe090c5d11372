"""Hybrid retrieval: vector hits and graph hits in one plan (ids of the blueprint in brackets)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import questions as Q
from graphloom.operators import graph, vector
from graphloom.session import parts_of, write_shared

SENT_SEEDS = 500_000  # rows of seeds that are sent to every task


def merge_hits(vectors: DataFrame, graphs: DataFrame, keys: list[str]) -> DataFrame:
    """[J2] Full outer join of vector_score and graph_score; source tells which of them found the chunk."""
    both = vectors.join(graphs, keys, "full_outer")
    source = F.when(F.col("vector_score").isNull(), "graph").when(F.col("graph_score").isNull(), "vector").otherwise("hybrid")
    return both.withColumn("source", source)


def graph_chunk_scores(paths: DataFrame, path_chunks: DataFrame, query_id: str = "query_id") -> DataFrame:
    """[H3] Mean score of the paths that hold a chunk; paths: query_id, nodes, score; path_chunks: node, chunk_id."""
    numbered = paths.withColumn("_p", F.monotonically_increasing_id())  # before the explosion, or each node would be a path
    each = numbered.select(query_id, "score", "_p", F.explode("nodes").alias("node")).join(path_chunks, "node")
    return each.dropDuplicates([query_id, "_p", "chunk_id"]).groupBy(query_id, "chunk_id").agg(F.avg("score").alias("graph_score"))


def seed_scores(seeds: DataFrame, found: DataFrame, node_points: DataFrame) -> DataFrame:
    """[H3] graph_chunk_scores of the paths (start, end, score) from each query's seeds: query_id, point_id, graph_score.

    A seed's paths are summed up by point before its queries meet them, so that a path to no point is not listed for every query.
    """
    numbered = found.select("start", "end", "score").withColumn("_p", F.monotonically_increasing_id())
    each = numbered.select("start", "score", "_p", F.explode(F.array("start", "end")).alias("node")).join(node_points.select("node", "point_id"), "node")
    sums = write_shared(each.dropDuplicates(["start", "_p", "point_id"]).groupBy("start", "point_id").agg(F.sum("score").alias("_s"), F.count("score").alias("_n")), "seed-scores")
    asks = seeds.select("query_id", F.col("node").alias("start"))
    rows = asks.groupBy("start").agg(F.count(F.lit(1)).alias("q")).join(sums.groupBy("start").agg(F.count(F.lit(1)).alias("p")), "start").agg(F.sum("q"), F.sum(F.col("q") * F.col("p"))).first()
    few = asks if (rows[0] or 0) > SENT_SEEDS else F.broadcast(asks)
    met = sums.repartition(parts_of(seeds.sparkSession, rows[1] or 0), "start", "point_id").join(few, "start")  # few rows that become many
    return met.groupBy("query_id", "point_id").agg((F.sum("_s") / F.sum("_n")).alias("graph_score"))


def coverage(chunks: DataFrame, wanted: DataFrame, query_id: str = "query_id") -> DataFrame:
    """[H3, U4] Share of a query's entities that a chunk mentions; wanted: query_id, entity_ids."""
    met = chunks.join(wanted.withColumnRenamed("entity_ids", "_w"), query_id, "left").withColumn("_w", F.coalesce("_w", F.array().cast(wanted.schema["entity_ids"].dataType)))
    return met.withColumn("entity_coverage_score", F.when(F.size("_w") > 0, F.size(F.array_intersect("entity_ids", "_w")) / F.size("_w")).otherwise(F.lit(0.0))).drop("_w")


def parse(questions: DataFrame, text: str = "q") -> DataFrame:
    """[T23-T28, F8, F15, H1, G10] The query IR as columns, for any number of questions at once."""
    q = F.col(text)
    out = questions.withColumn("query_id", Q.query_id(q)).withColumn("_i", Q.intent(q)).withColumn("intent", F.col("_i.intent")).withColumn("intent_confidence", F.col("_i.confidence")).drop("_i")
    out = out.withColumn("relationship_types", Q.relationship_types(q)).withColumn("mentions", Q.mentions(q)).withColumn("keywords", Q.keywords(q)).withColumn("constraints", Q.constraints(q)).withColumn("expansions", Q.expansions(q))
    out = out.withColumn("needs_graph", Q.needs_graph(F.col("intent"), F.col("relationship_types"), q)).withColumn("max_depth", Q.max_depth(q)).withColumn("complex", Q.is_complex(F.col("intent"), F.col("relationship_types"), q)).withColumn("valid", Q.is_valid(q))
    return out.withColumn("strategy", Q.strategy(F.col("intent"), F.size("mentions"), F.col("needs_graph"))).withColumn("graph_strategy", Q.graph_strategy(F.col("relationship_types"), F.size("mentions")))


def retrieve(queries: DataFrame, points: DataFrame, seeds: DataFrame, edges: DataFrame, nodes: DataFrame, node_points: DataFrame, k: int = 10, least: float = 0.0, types=None, depth: int = 1, strategy: str = "hybrid_parallel", wanted: DataFrame | None = None, about: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
    """[H2] query_id, point_id, vector_score, graph_score, entity_coverage_score, source, score, rank.

    queries: query_id, vector; seeds: query_id, node; node_points: node, point_id. vector_first walks from what the
    vectors found, graph_first ranks by vectors only what the walk found; parallel unites both. wanted (query_id,
    entity_ids) and about (point_id, entity_ids, confidence_score) give coverage and confidence; a signal that is not
    known is null and left out of the fusion. topics (point_id) restricts the points before the search. A side without
    hits, or that is not there at all, leaves the other side's hits as they are.
    """
    if topics is not None:
        points = points.join(topics.select("point_id").distinct(), "point_id", "left_semi")
        node_points = node_points.join(topics.select("point_id").distinct(), "point_id", "left_semi")
    v = vector.normalize_scores(vector.top_k(queries, points, 2 * k, least)).select("query_id", "point_id", F.col("normalized").alias("vector_score"))
    if strategy == "vector_first":
        seeds = v.join(node_points, "point_id").select("query_id", "node").distinct()
    starts = seeds.select("node").distinct()
    if strategy != "vector_first" and starts.count() <= SENT_SEEDS:  # they go to the edges, or the edges go to the one task that holds them
        starts = F.broadcast(starts)
    found = graph.score_paths(graph.traverse(starts, edges, depth, types, "both"), nodes)
    g = seed_scores(seeds, found, node_points)
    if strategy == "vector_only":
        g = g.limit(0)
    if strategy == "graph_only":
        v = v.limit(0)
    both = merge_hits(v, g, ["query_id", "point_id"])
    if strategy == "graph_first":
        both = both.filter("graph_score is not null")
    rows = both if about is None else both.join(about, "point_id", "left")
    if about is None:
        rows = rows.withColumn("confidence_score", F.lit(None).cast("double"))
    if about is None or wanted is None:
        rows = rows.withColumn("entity_coverage_score", F.lit(None).cast("double"))
    else:
        rows = coverage(rows.withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast(about.schema["entity_ids"].dataType))), wanted)
    return vector.rank(vector.fuse(rows), "score", "point_id").filter(F.col("rank") <= k).select("query_id", "point_id", "vector_score", "graph_score", "entity_coverage_score", "source", "score", "rank")


def deep_research(question: str, search: Callable[[str, int], DataFrame], sufficient: Callable[[str, list[str]], bool], sub_queries: Callable[[str, list[str]], list[str]], answer: Callable[[str, list[str]], str], rounds: int = 3) -> dict:
    """[H4] Searches, judges, asks on, at most `rounds` times; what is seen is left out by an anti-join. Bounded by 5 hits a search."""
    seen = search(question, 5).select("chunk_id", "content", "score")
    for _ in range(rounds):
        top = [r.content[:200] for r in seen.orderBy(F.desc("score"), "chunk_id").limit(20).collect()]
        try:
            enough = sufficient(question, top)
        except Exception:  # a judge that fails has not found it sufficient
            enough = False
        asks = [] if enough else sub_queries(question, top)
        if not asks:
            break
        fresh = None
        for a in asks:
            hits = search(a, 5).select("chunk_id", "content", "score").join(seen.select("chunk_id"), "chunk_id", "left_anti")
            fresh = hits if fresh is None else fresh.unionByName(hits)
        fresh = fresh.dropDuplicates(["chunk_id"])
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    best = [r.content for r in seen.orderBy(F.desc("score"), "chunk_id").limit(5).collect()]
    return {"answer": answer(question, best), "chunks": len(best)}
