"""Cleaning, normalising, life cycle, configuration, duplicate suggestions: exact values."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import udfs
from graphloom.operators import candidates, cleaning, curate, vector
from graphloom.sources import config
from graphloom.streaming.lifecycle import Ingestion


def test_cleaning_protects_and_repairs(spark):
    text = "DRAFT report\nThe NASA   unit has 5.0 V and `x  y` code, modern.\nPage 3 of 9\n\n\n\n12 l 7 and PowerBus"
    row = cleaning.clean(spark.createDataFrame([(text,), (None,)], "text string")).first()
    assert row.cleaned == "report\nThe NASA unit has 5.0 V and `x  y` code, modern.\n\n12 1 7 and PowerBus"


def test_normaliser_keeps_terms():
    assert udfs.normalize_term("  The C++  module–A ") == ("c++ module - a", "C++ module - A", ["C++"])
    assert udfs.normalize_term("ｆｕｌｌ width NASA (L2)")[:2] == ("full width nasa l2", "full width NASA L2")
    assert udfs.normalize_term(None) == ("", "", [])


def test_unknown_types_meet_every_type(spark):
    rows = spark.createDataFrame([(1, "SYSTEM", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "MODE", [1.0, 0.1]), (4, "unknown", [0.0, 1.0]), (5, "UNKNOWN", [1.0, 0.0]), (6, "MODE", None)], "entity_id long, entity_type string, vector array<double>")
    got = {(r.a, r.b) for r in vector.similar_pairs(rows, 0.9).collect()}
    assert got == {(1, 2), (1, 5), (2, 3), (2, 5), (3, 5)}


def test_top_k_leaves_out_rows_without_a_vector(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)] + [(99, None)], "point_id long, vector array<double>")
    got = vector.top_k(spark.createDataFrame([(100, [9.0, 1.0]), (101, None)], "query_id long, vector array<double>"), points, 3).orderBy("rank").collect()
    assert [r.point_id for r in got] == [8, 7, 6]


def test_search_pages_and_levels(spark):
    points = spark.createDataFrame([(i, [1.0, i / 10], i % 2 + 1, f"text {i}") for i in range(8)], "point_id long, vector array<double>, level int, content string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    got = vector.search(asked, points, 4, 0.1, level=1, number=2, size=2, use_mmr=True)
    assert got.count() == 2 and not got.first().has_more
    with pytest.raises(ValueError):
        vector.by_level(asked, points, 5)


def test_validity_takes_any_scorer(spark):
    known = spark.createDataFrame([(1, "Power Bus"), (1, "Pump")], "chunk_id long, name string")
    rows = spark.createDataFrame([(1, "power buss", "pump", "CONTAINS", 0.9), (1, "radio", "pump", "CONTAINS", 0.9), (2, "a", "b", "CONTAINS", 0.9)], "chunk_id long, source string, target string, type string, confidence double")
    assert {r.source: r.reason for r in candidates.validity(rows, known).collect()} == {"power buss": None, "radio": "unknown_source", "a": "no_known_entities"}


def test_duplicate_suggestions(spark):
    rows = spark.createDataFrame([("A", "Power Bus", ["pb"]), ("B", "Bus", ["PB"]), ("C", "pb", []), ("D", "Power Buss", []), ("E", "radio", [])], "candidate_key string, canonical_name string, aliases array<string>")
    got = curate.duplicate_suggestions(rows.filter("candidate_key = 'A'"), rows).orderBy("rank").collect()
    assert [(r.target, r.reason) for r in got] == [("B", "shared_alias"), ("D", "similar_name"), ("C", "alias_match")]


def test_life_cycle_rolls_back(spark, tmp_path):
    docs = spark.createDataFrame([("1", "x"), ("2", "y")], "document_id string, checksum string")
    run = Ingestion(spark, f"file://{tmp_path}")
    assert run.chunks() is None
    broken = run.run(docs, lambda df: df.select("document_id", F.raise_error(F.lit("no")).alias("content")))
    assert broken["status"] == "failed" and {r.status for r in run.statuses().collect()} == {"failed"}
    good = run.run(docs, lambda df: df.select("document_id", F.lit("text").alias("content")))
    assert good["status"] == "completed" and good["chunks"] == 2 and run.chunks().count() == 2
    again = run.run(docs, lambda df: df.select("document_id", F.lit("text").alias("content")))
    assert again["chunks"] == 0 and run.chunks().count() == 2


def test_configuration(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"search": {"k": 5}}))
    got = config.load(str(path), {"search": {"k": 20, "least": 0.5}}, env={"GRAPHLOOM__SEARCH__LEAST": "0.7", "GRAPHLOOM__NAME": "x", "OTHER": "1"})
    assert got == {"search": {"k": 5, "least": 0.7}, "name": "x"}
    (tmp_path / "p.jsonl").write_text('{"label": "system", "pattern": "main bus"}\n{"label": "unit", "pattern": [{"LOWER": "star"}, {"LOWER": "tracker"}]}\n')
    assert {(r.term, r.type) for r in config.patterns(spark, f"file://{tmp_path}/p.jsonl").collect()} == {("main bus", "SYSTEM"), ("star tracker", "UNIT")}
