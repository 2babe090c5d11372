"""Text cleaning as one operator (ids of the blueprint in brackets)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions import udfs


def clean(texts: DataFrame, text: str = "text", out: str = "cleaned") -> DataFrame:
    """[T1-T4] Adds `out`: code, equations, acronyms, names, measures and citations stand aside; then headers, footers,
    page numbers, watermarks and noise go, numbers and words are repaired, white space is tidied; what stood aside returns.
    """
    held = texts.withColumn("_p", udfs.protect(F.col(text)))
    repaired = X.ocr_words(udfs.ocr_numbers(X.remove_boilerplate(F.col("_p.text"))))
    return held.withColumn(out, udfs.restore(X.tidy_whitespace(repaired), F.col("_p.held"))).drop("_p")


def statistics(cleaned: DataFrame, before: str = "text", after: str = "cleaned") -> DataFrame:
    """[A16] Adds original_length, cleaned_length, characters_removed, removal_percentage, original_lines, cleaned_lines."""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    lines = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)).cast("long")
    share = F.when(size(before) > 0, 100.0 * (size(before) - size(after)) / size(before)).otherwise(F.lit(0.0))
    return cleaned.withColumns({"original_length": size(before), "cleaned_length": size(after), "characters_removed": size(before) - size(after), "removal_percentage": share, "original_lines": lines(before), "cleaned_lines": lines(after)})
