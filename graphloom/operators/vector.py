"""Vector search and ranking (ids of the blueprint in brackets). Vectors are array<float>, scores double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import scores

MAX_QUERY_BYTES = 64_000_000
PART_ROWS = 2000  # rows of a type that a task compares with as many others
UNKNOWN = "UNKNOWN"


def payload_filter(hits: DataFrame, document_ids=None, level=None, entity_ids=None) -> DataFrame:
    """Conjunction of the conditions that are given: any of the documents, the level, any of the entities."""
    if document_ids is not None:
        hits = hits.filter(F.col("document_id").isin(list(document_ids)))
    if level is not None:
        hits = hits.filter(F.col("level") == level)
    if entity_ids is not None:
        hits = hits.filter(F.arrays_overlap("entity_ids", F.array(*map(F.lit, entity_ids))))
    return hits


def top_k(queries: DataFrame, points: DataFrame, k: int = 20, least: float = 0.5, query_id: str = "query_id", point_id: str = "point_id", same: Column | None = None, exclude_self: bool = True) -> DataFrame:
    """[W9] The k points of highest cosine for each query, at or above `least`: query_id, point_id, score, rank.

    queries (query_id, vector) is a stated query set: its size is measured, and it is sent to the points in blocks of at
    most MAX_QUERY_BYTES. Each partition keeps its own k best by a matrix product, so what is shuffled is k rows a query
    and partition.
    """
    spark = points.sparkSession
    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-8 * int(stats.d) // MAX_QUERY_BYTES))
    parts = []
    for b in range(blocks):
        some = queries.filter("vector is not null").filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else queries.filter("vector is not null")
        rows = some.select(query_id, "vector").collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64) if rows else np.zeros((0, 0))))
        parts.append(points.select(F.col(point_id).alias("point_id"), "vector").mapInArrow(_best(sent, k, least, exclude_self), T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("point_id", points.schema[point_id].dataType), T.StructField("score", T.DoubleType())])))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "point_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best(sent, k: int, least: float, exclude_self: bool):
    """Each task keeps the best of its points for each query and hands them on once, at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        if not len(ids):
            return
        q = _unit_rows(vectors)
        places: dict = {}
        for i, x in enumerate(ids):
            places.setdefault(x, []).append(i)
        held: list[tuple[np.ndarray, list, np.ndarray]] = []  # queries' places, points, scores
        kind = None
        for batch in batches:
            kind = batch.schema.field("point_id").type
            batch = batch.filter(pc.is_valid(batch.column("vector")))
            if not batch.num_rows:
                continue
            points = batch.column("point_id").to_pylist()
            p = _unit_rows(np.array(batch.column("vector").to_pylist(), np.float64))
            own = [(i, j) for j, x in enumerate(points) for i in places.get(x, ())] if exclude_self else []
            for at in range(0, len(ids), 512):
                s = q[at : at + 512] @ p.T
                for i, j in own:
                    if at <= i < at + 512:
                        s[i - at, j] = -2.0
                ok = s >= least - 1e-12
                if p.shape[0] > k:  # ties at the cut stay, the window orders them
                    ok &= s >= np.partition(s, -k, axis=1)[:, -k][:, None] - 1e-9
                i, j = np.nonzero(ok)
                held.append((at + i, [points[x] for x in j.tolist()], s[i, j]))
            if sum(len(h[1]) for h in held) > 4 * k * len(ids) + 100_000:
                held = [_cut(held, k)]
        if held:
            at, found, s = _cut(held, k)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at.tolist()]), pa.array(found, kind), pa.array(s)], names=["query_id", "point_id", "score"])

    return run


def _cut(held: list, k: int) -> tuple[np.ndarray, list, np.ndarray]:
    """What is among the k best of its query, ties at the cut included."""
    at, s = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
    found = [x for h in held for x in h[1]]
    order = np.lexsort((-s, at))
    first = np.searchsorted(at[order], at[order])
    kth = np.minimum(first + k - 1, np.searchsorted(at[order], at[order], "right") - 1)
    keep = order[s[order] >= s[order][kth] - 1e-9]
    return at[keep], [found[i] for i in keep.tolist()], s[keep]


def normalize_scores(hits: DataFrame, query_id: str = "query_id", score: str = "score") -> DataFrame:
    """[W1] Adds `normalized`, min-max over each query's hits."""
    w = W.partitionBy(query_id)
    return hits.withColumn("normalized", scores.minmax(F.col(score), F.min(score).over(w), F.max(score).over(w)))


def page(ranked: DataFrame, size: int, number: int, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """[W10] Page `number` of each query, with has_more: whether a hit lies beyond it."""
    most = F.max(rank).over(W.partitionBy(query_id))
    return ranked.withColumn("has_more", most > size * number).filter(F.col(rank).between(size * (number - 1) + 1, size * number))


def rank(hits: DataFrame, score: str, tie: str, query_id: str = "query_id") -> DataFrame:
    """[W2] rank 1..n by score, then tie."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.round(score, 9).desc(), tie)))


def _tokens(text: str) -> set[str]:
    return set((text or "").lower().split())


def _overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def mmr(hits: DataFrame, lam: float = 0.5, k: int = 20, query_id: str = "query_id") -> DataFrame:
    """[W3] Greedy maximal marginal relevance over at most k hits a query (query_id, chunk_id, content, score): adds mmr_rank."""
    schema = T.StructType([*hits.schema.fields, T.StructField("mmr_rank", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).head(k).reset_index(drop=True)
        tokens = [_tokens(t) for t in pdf["content"]]
        left, chosen, worst = list(range(len(pdf))), [], [0.0] * len(pdf)
        while left:
            best = max(left, key=lambda i: (lam * pdf["score"][i] - (1 - lam) * worst[i] if chosen else pdf["score"][i], -i))
            chosen.append(best)
            left.remove(best)
            for i in left:
                worst[i] = max(worst[i], _overlap(tokens[i], tokens[best]))
        out = pdf.iloc[chosen].copy()
        out["mmr_rank"] = range(1, len(chosen) + 1)
        return out

    top = hits.withColumn("_r", F.row_number().over(W.partitionBy(query_id).orderBy(F.col("score").desc(), "chunk_id"))).filter(F.col("_r") <= k).drop("_r")
    return top.groupBy(query_id).applyInPandas(run, schema)


def diversify(hits: DataFrame, weight: float = scores.DIVERSITY, k: int = 50, query_id: str = "query_id") -> DataFrame:
    """[W4] Greedy diversity rerank: adds diversity_score and final_score; the first hit keeps its score."""
    schema = T.StructType([*hits.schema.fields, T.StructField("diversity_score", T.DoubleType()), T.StructField("final_score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).head(k).reset_index(drop=True)
        tokens = [_tokens(t) for t in pdf["content"]]
        left, chosen, worst = list(range(1, len(pdf))), [0], [0.0] * len(pdf)
        final, diversity = [0.0] * len(pdf), [1.0] * len(pdf)
        final[0] = pdf["score"][0]
        last = 0
        while left:
            for i in left:
                worst[i] = max(worst[i], _overlap(tokens[i], tokens[last]))
            last = max(left, key=lambda i: (pdf["score"][i] * (1 - weight) + (1 - worst[i]) * weight, -i))
            diversity[last], final[last] = 1 - worst[last], pdf["score"][last] * (1 - weight) + (1 - worst[last]) * weight
            chosen.append(last)
            left.remove(last)
        pdf["diversity_score"], pdf["final_score"] = diversity, final
        out = pdf.sort_values(["final_score", "chunk_id"], ascending=[False, True])
        out["rank"] = range(1, len(out) + 1)
        return out

    top = hits.withColumn("_r", F.row_number().over(W.partitionBy(query_id).orderBy(F.col("score").desc(), "chunk_id"))).filter(F.col("_r") <= k).drop("_r")
    return top.groupBy(query_id).applyInPandas(run, schema)


def fuse(hits: DataFrame, enabled: bool = True) -> DataFrame:
    """[W5] Adds score from vector_score, graph_score, entity_coverage_score and confidence_score."""
    return hits.withColumn("score", scores.fuse(F.col("vector_score"), F.col("graph_score"), F.col("entity_coverage_score"), F.col("confidence_score"), enabled))


def rerank(hits: DataFrame, k: int = 10, diversity: bool = True, query_id: str = "query_id") -> DataFrame:
    """[W6] Fusion, diversity, order, cut, rank."""
    fused = fuse(hits)
    if diversity:
        return diversify(fused, query_id=query_id).filter(F.col("rank") <= k)
    return rank(fused.withColumn("final_score", F.col("score")), "final_score", "chunk_id", query_id).filter(F.col("rank") <= k)


def similar_pairs(records: DataFrame, least: float = 0.85, block: str = "entity_type", key: str = "entity_id") -> DataFrame:
    """[J7] Pairs a < b with cosine >= least, of one type or with a side of no known type: a, b, block, similarity.

    A row without a type, or of type UNKNOWN, meets the rows of every type. A type is cut into parts of about PART_ROWS
    rows, and each pair of parts is one matrix product; so a type of any size is many tasks, and none holds it whole.
    """
    kind = F.upper(F.coalesce(F.col(block).cast("string"), F.lit(UNKNOWN)))
    rows = records.filter(F.col("vector").isNotNull()).select(F.col(key).alias("k"), "vector", kind.alias("kind"))
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    loose = F.coalesce(F.sum(F.when(F.col("kind") == UNKNOWN, F.col("n"))).over(W.partitionBy()), F.lit(0))
    sizes = counts.withColumn("parts", F.ceil((F.col("n") + F.when(F.col("kind") != UNKNOWN, loose).otherwise(0)) / PART_ROWS).cast("int"))
    kinds = sizes.agg(F.collect_list(F.struct("kind", "parts")).alias("every"))  # one row; there are few types
    met = rows.crossJoin(kinds).select("k", "vector", (F.col("kind") == UNKNOWN).alias("loose"), F.explode(F.filter("every", lambda x: (F.col("kind") == UNKNOWN) | (x["kind"] == F.col("kind")))).alias("in"))
    mine = F.pmod(F.xxhash64("k"), F.col("in.parts")).cast("int")
    spread = met.withColumn("p", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("in.parts") - 1)))
    units = spread.select("k", "vector", "loose", F.col("in.kind").alias("kind"), F.least("p", "o").alias("lo"), F.greatest("p", "o").alias("hi"), "p")
    unit_key = records.schema[key].dataType
    schema = T.StructType([T.StructField("a", unit_key), T.StructField("b", unit_key), T.StructField(block, T.StringType()), T.StructField("similarity", T.DoubleType())])
    return units.groupBy("kind", "lo", "hi").applyInArrow(_pairs_of_unit(least, block), schema)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A row for each vector; they are of one length."""
    sizes = pc.list_value_length(vectors)
    if len(pc.unique(sizes)) != 1:
        return np.array(vectors.to_pylist(), np.float64)  # which says what is wrong
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in vectors.chunks]).reshape(len(vectors), -1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _pairs_of_unit(least: float, block: str):
    def run(t: pa.Table) -> pa.Table:
        kind, lo, hi = (t.column(c)[0].as_py() for c in ("kind", "lo", "hi"))
        keys = t.column("k").combine_chunks()
        place = pc.rank(keys, tiebreaker="dense").to_numpy()
        m = _unit_rows(_matrix(t.column("vector")))
        loose, part = t.column("loose").to_numpy(), t.column("p").to_numpy()
        found = []
        for at in range(0, len(keys), 512):
            s = m[at : at + 512] @ m.T
            i, j = np.nonzero(s >= least)
            x = i + at
            ok = place[x] < place[j]
            if lo != hi:
                ok &= part[x] != part[j]
            if kind != UNKNOWN:
                ok &= ~(loose[x] & loose[j])
            found.append((x[ok], j[ok], s[i[ok], j[ok]]))
        a, b, similarity = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b)), block: pa.repeat(pa.scalar(kind, pa.string()), len(a)), "similarity": pa.array(similarity, pa.float64())})

    return run


def search(queries: DataFrame, points: DataFrame, k: int = 20, least: float = 0.5, document_ids=None, level: int | None = None, entity_ids=None, number: int = 1, size: int | None = None, use_mmr: bool = False, lam: float = 0.5) -> DataFrame:
    """[W11] Filters, top k, normalised scores, diversity if asked for, and one page of `size` hits (by default all k).

    points: point_id, vector, content, and document_id, level, entity_ids where filters ask for them. Columns query_id,
    point_id, content, score, normalized, rank, has_more.
    """
    if level is not None and level not in (1, 2, 3, 4):
        raise ValueError("a level is 1, 2, 3 or 4")
    if number < 1 or (size is not None and size < 1):
        raise ValueError("pages count from 1 and hold a hit at least")
    some = payload_filter(points, document_ids, level, entity_ids)
    hits = normalize_scores(top_k(queries, some, k, least)).join(some.select("point_id", "content"), "point_id")
    if use_mmr:
        named = hits.drop("rank").withColumnRenamed("point_id", "chunk_id")
        hits = mmr(named, lam, k).withColumnRenamed("chunk_id", "point_id").withColumnRenamed("mmr_rank", "rank")
    return page(hits.select("query_id", "point_id", "content", "score", "normalized", "rank"), size or k, number)


def by_document(queries: DataFrame, points: DataFrame, document_id, k: int = 20, least: float = 0.0) -> DataFrame:
    """[W11]"""
    return search(queries, points, k, least, document_ids=[document_id])


def by_entity(queries: DataFrame, points: DataFrame, entity_ids, k: int = 20, least: float = 0.0) -> DataFrame:
    """[W11]"""
    return search(queries, points, k, least, entity_ids=entity_ids)


def by_level(queries: DataFrame, points: DataFrame, level: int, k: int = 20, least: float = 0.0) -> DataFrame:
    """[W11]"""
    return search(queries, points, k, least, level=level)
