"""Connected components of an undirected edge table, by alternating large-star and small-star rounds.

Each round is pre-aggregated minima and salted joins, so a hub's edges are never in one task; the edges of a round are written to the shared folder, so no lineage
grows and nothing is gathered on the driver but a count and a checksum for the end test. A round's table goes after the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import drop_shared, write_shared

SALTS = 32


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1))), F.lit(0)).alias("h")).first()
    return row.n, row.h


def _least(edges: DataFrame) -> DataFrame:
    """edges with m, the least b of their a. A hub's edges are dealt to SALTS parts, each of which learns m once."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("a", "_s").agg(F.min("b").alias("_m"))
    whole = parts.groupBy("a").agg(F.min("_m").alias("m"), F.collect_list("_s").alias("_parts"))
    return salted.join(whole.select("a", "m", F.explode("_parts").alias("_s")), ["a", "_s"]).select("a", "b", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node reachable) of every node that has an edge to another one."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()  # a is above b
    now = write_shared(now, "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _least(large)
        after = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, write_shared(after, "edges")
        was, mark = mark, _mark(now)
        drop_shared(before)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
