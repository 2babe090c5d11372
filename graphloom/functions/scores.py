"""Scores: Column in, Column out (ids of the blueprint in brackets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fusion weights of vector, graph, coverage, confidence and diversity.
FUSION = (0.4, 0.3, 0.15, 0.10)
DIVERSITY = 0.05


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """[T29]"""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """[T29] 0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def minmax(x: Column, low: Column, high: Column) -> Column:
    """[W1] 1 where the range is nil."""
    return F.when(high - low < 1e-10, F.lit(1.0)).otherwise((x - low) / (high - low))


def fuse(vector: Column, graph: Column, coverage: Column, confidence: Column, enabled: bool = True) -> Column:
    """[W5] Weighted mean over what is there; disabled: the plain mean."""
    parts = list(zip((vector, graph, coverage, confidence), FUSION if enabled else (1.0,) * 4, strict=True))
    top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    under = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for x, w in parts), F.lit(0.0))
    return F.when(under > 0, top / under).otherwise(F.lit(0.0))


def path_score(length: Column, first: Column, last: Column) -> Column:
    """[G9] 0.6 / (1 + length) + 0.4 * mean confidence of the ends, clamped."""
    return clamp(F.lit(0.6) / (1 + length) + F.lit(0.4) * (F.coalesce(first, F.lit(0.5)) + F.coalesce(last, F.lit(0.5))) / 2)


def pmi(both: Column, left: Column, right: Column, total: Column) -> Column:
    """[A7] log2 of p(x, y) / (p(x) p(y))."""
    return F.log2(both / total / ((left / total) * (right / total)))


def edit_similarity(a: Column, b: Column) -> Column:
    """[T11] 1 - edit distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def fuzzy_threshold(a: Column, b: Column, base: float = 0.90) -> Column:
    """[T12] Short names ask for more; at most 0.99."""
    short = F.least(F.length(a), F.length(b))
    return F.when(short == 0, F.lit(1.0)).otherwise(F.least(F.lit(0.99), F.when(short < 4, F.greatest(F.lit(base), F.lit(0.96))).when(short < 8, F.lit(base) + 0.02).otherwise(F.lit(base))))


def fuzzy_confidence(score: Column, threshold: Column, a: Column, b: Column) -> Column:
    """[T13] Score less a quarter of the length difference (at most 0.4 of the longer), more what exceeds the threshold."""
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    return clamp(score - F.lit(0.25) * F.least(F.abs(F.length(a) - F.length(b)) / longer, F.lit(0.4)) + F.greatest(F.lit(0.0), score - threshold))


def type_alignment(a: Column, b: Column) -> Column:
    unknown = a.isNull() | b.isNull() | (F.upper(a) == "UNKNOWN") | (F.upper(b) == "UNKNOWN")
    return F.when(unknown, F.lit(0.5)).when(F.upper(a) == F.upper(b), F.lit(1.0)).otherwise(F.lit(0.2))


def dedup_confidence(similarity: Column, alignment: Column, least_mentions: Column, wanted: int = 2) -> Column:
    """[T31]"""
    return clamp(F.lit(0.7) * similarity + F.lit(0.2) * alignment + F.lit(0.1) * F.least(F.lit(1.0), least_mentions / F.lit(max(1, wanted))))


# Base scores of mention sources, salient words, types with a bonus, types that may hold digits.
SOURCE_BASE = {"gazetteer": 0.72, "phrase": 0.68, "ner": 0.55}
SALIENT = r"(?i)system|subsystem|module|unit|procedure|mode"
BONUS_TYPES = ("SYSTEM", "SUBSYSTEM", "COMPONENT")
DIGIT_TYPES = ("PARAMETER", "ANOMALY")


def mention_score(text: Column, kind: Column, source: Column, context: Column) -> Column:
    """[T20]"""
    base = F.lit(0.60)
    for name, value in SOURCE_BASE.items():
        base = F.when(source == name, F.lit(value)).otherwise(base)
    score = base + F.least(F.length(text) / 50, F.lit(0.10))
    score += F.when(context.rlike(SALIENT), F.lit(0.05)).otherwise(F.lit(0.0))
    score += F.when(kind.isin(*BONUS_TYPES), F.lit(0.05)).otherwise(F.lit(0.0))
    score -= F.when(text.rlike(r"\d") & ~kind.isin(*DIGIT_TYPES), F.lit(0.05)).otherwise(F.lit(0.0))
    return clamp(score)


def noisy_or(confidences: Column, extractors: Column | None = None) -> Column:
    """[A10] 1 - product of (1 - c), more 0.05 for two extractors, at most 1. confidences: an array, zeros are left out."""
    rest = F.aggregate(F.filter(confidences, lambda c: c > 0), F.lit(1.0), lambda a, c: a * (1 - c))
    bonus = F.when(extractors >= 2, F.lit(0.05)).otherwise(F.lit(0.0)) if extractors is not None else F.lit(0.0)
    return F.least(F.lit(1.0), 1 - rest + bonus)


def answer_confidence(answer: Column, mean_score: Column) -> Column:
    """[T34]"""
    out = F.coalesce(mean_score, F.lit(0.0))
    out = F.when(F.size(F.split(F.trim(answer), r"\s+")) < 10, out * 0.5).otherwise(out)
    return clamp(F.when(F.lower(answer).contains("don't have enough information") | F.lower(answer).contains("cannot answer"), out * 0.2).otherwise(out))
