"""Mixing sources to target weights by a time-varying curriculum (operator 10).

Targets: the sources, in code-point order with null last, get the weights in turn and share `budget` times all sizes;
a target stops at `cap` times its source's size and the excess is shared again by weight (water filling).
Curriculum: the intensity of a source changes linearly over the training run, w(t) = target * (1 + slope * (2t - 1)) for
t in [0, 1], so that its integral is the target. Its cumulative demand, target * ((1 - slope) t + slope t^2), is
inverted at each document's place in the source's stream, which assigns the document a training position; documents
are then range-sorted by position.

Order within a source is by md5 of the id, and of a tie-breaking column (by default the text) for rows that share an id or
have none, so reruns agree. No source is gathered in one task: running sums go over (source, bucket) and within such a
bucket only. Windows over sources hold one row each.

Defined cases: a null text has size 0; a null source is a source of its own; sizes of 0 are never taken; repeated rows are
documents of their own; a text of any length is counted whole; docs' columns travel in a struct, so their names clash
with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (-0.5, 0.0, 0.5)
HEX_DIGITS = 3  # buckets of a source: 16 ** HEX_DIGITS


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source (source, source_size) to its target, slope; windows here run over sources, not documents."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), at)
    named = sizes.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)).withColumn("limit", F.lit(cap) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    here_on = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.col("total") - F.col("full_below")) / F.col("weight_left")
    filled = (
        named.withColumn("total", F.lit(budget) * F.sum("source_size").over(everything))
        .withColumn("full_below", F.coalesce(F.sum("limit").over(below), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(here_on))
        .withColumn("level", F.max(F.when(level <= F.col("limit") / F.col("weight"), level)).over(everything))
    )
    return filled.select("source", "source_size", F.least("limit", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target"), "slope")


def _inverse(share: Column, slope: Column) -> Column:
    """The training time at which the cumulative demand reaches this share of the target."""
    b = 1 - slope
    return 2 * share / (b + F.sqrt(b * b + 4 * slope * share))


def mix(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, tie: Column | None = None, weights=WEIGHTS, slopes=SLOPES, budget: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Columns row (df's own), size, source_size, target, taken and positions: in [0, 1], one for each pass that takes of the document."""
    named = F.col(f"`{doc_id}`").cast("string")
    digest = F.md5(F.concat(F.coalesce(named, F.lit("")), F.lit(":"), F.coalesce(tie if tie is not None else F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(""))))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        (size if size is not None else word_count(F.col(f"`{text}`"))).alias("size"),
        digest.alias("_key"),
        F.substring(digest, 1, HEX_DIGITS).alias("_bucket"),
    )
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    per_source = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, slopes, budget, cap)
    buckets = sums.alias("b").join(per_source.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b._bucket", "_offset", "source_size", "target", "slope")
    both = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).join(
        buckets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_s"), "_bucket", "_offset", "source_size", "target", "slope"), ["_s", "_bucket"]
    )
    within = W.partitionBy("_s", "_bucket").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    goal = F.round("target").cast("long")
    # the source's documents in order, again and again, are a stream of which the mix takes the first `goal` words
    in_pass = lambda k: F.least(F.greatest(goal - k * F.col("source_size") - F.col("_before"), F.lit(0)), F.col("size"))
    staged = both.withColumn("_before", before).withColumn("_taken", F.array(*[in_pass(F.lit(k)).cast("long") for k in range(math.ceil(cap))]))
    at = lambda k: _inverse(F.least((k * F.col("source_size") + F.col("_before")) / F.col("target"), F.lit(1.0)), F.col("slope"))
    each = F.filter(F.transform("_taken", lambda n, k: F.when(n > 0, at(k))), lambda x: x.isNotNull())
    return staged.select("row", "size", "source_size", "target", F.aggregate("_taken", F.lit(0).cast("long"), lambda a, n: a + n).alias("taken"), each.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts what mix() returned by first training position; documents that the mix leaves out come first."""
    first = F.get("positions", F.lit(0))
    return mixed.repartitionByRange(first, F.col("size")).sortWithinPartitions(first, "size")


def copies(mixed: DataFrame) -> DataFrame:
    """The mix as rows with the original columns: each document once for each pass that takes at least half of it, in training order."""
    times = F.floor((F.col("taken") + F.col("size") / 2) / F.when(F.col("size") > 0, F.col("size"))).cast("int")
    spread = mixed.select("row", F.explode(F.slice("positions", F.lit(1), F.coalesce(times, F.lit(0)))).alias("_at"))
    return spread.repartitionByRange("_at").sortWithinPartitions("_at").select("row.*")
