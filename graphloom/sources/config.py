"""Configuration and pattern files (ids of the blueprint in brackets)."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _merged(base: dict, over: Mapping) -> dict:
    return base | {k: _merged(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, Mapping) else v for k, v in over.items()}


def _typed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def load(path: str | None, defaults: dict, prefix: str = "GRAPHLOOM", env: Mapping[str, str] | None = None) -> dict:
    """[SRC9] defaults, then the file (JSON, or YAML where a YAML library is there), then variables PREFIX__SECTION__KEY.

    A missing file is an error, an unknown section is kept, values of variables are read as JSON where they are JSON.
    """
    out = dict(defaults)
    if path is not None:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("reading YAML takes a YAML library; give JSON instead") from error
            found = yaml.safe_load(text) or {}
        else:
            found = json.loads(text or "{}")
        if not isinstance(found, dict):
            raise ValueError("a configuration is a mapping")
        out = _merged(out, found)
    for name, value in sorted((os.environ if env is None else env).items()):
        keys = name.split("__")
        if keys[0] == prefix and len(keys) > 1:
            over = _typed(value)
            for k in reversed(keys[1:]):
                over = {k.lower(): over}
            out = _merged(out, over)
    return out


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """[SRC9] term, type, source of a JSONL pattern file (label, pattern as text or as a list of lower-cased words)."""
    rows = spark.read.schema("label string, pattern string, type string, term string").json(path)
    from pyspark.sql import functions as F

    words = F.array_join(F.from_json("pattern", "array<struct<LOWER:string>>")["LOWER"], " ")
    return rows.select(F.coalesce("term", F.when(F.col("pattern").startswith("["), words), "pattern").alias("term"), F.upper(F.coalesce("type", "label")).alias("type"), F.lit("gazetteer").alias("source")).filter("term <> ''")
