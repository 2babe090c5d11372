"""Operators on small tables."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import udfs
from graphloom.operators import candidates, chunks, curate, discover, extract, graph, vector
from graphloom.operators.components import components
from graphloom.plans import commands
from graphloom.sources import files, sinks
from graphloom.streaming import updates


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cooccurrence(spark):
    m = spark.createDataFrame([("c1", "A"), ("c2", "A"), ("c1", "B"), ("c2", "C")], "chunk_id string, key string").withColumn("confidence", F.lit(0.5)).withColumn("mention_count", F.lit(1))
    assert rows(discover.cooccurrence(m, 1)) == [("A", "B", 1, 0.0), ("A", "C", 1, 0.0)]


def test_clusters(spark):
    e = spark.createDataFrame([("A", "B", 1), ("C", "D", 1)], "left string, right string, n long")
    got = discover.clusters(e, components, 1)
    assert {(r.node, r.size, r.cohesion) for r in got.collect()} == {(x, 2, 1.0) for x in "ABCD"}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(chain).collect()} == {0}


def test_traversal_is_of_trails(spark):
    e = spark.createDataFrame([("1", "a", "b", "X"), ("2", "b", "c", "X"), ("3", "c", "a", "X")], "edge_id string, src string, dst string, type string")
    s = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.traverse(s, e, 4)) == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2)]
    assert rows(graph.traverse(s, e, 2, direction="both", min_depth_only=True)) == [("a", "b", 1), ("a", "c", 1)]
    p = graph.find_paths(spark.createDataFrame([("a", "c")], "start string, end string"), e, 3)
    assert [r.nodes for r in p.orderBy("n").collect()] == [["a", "c"], ["a", "b", "c"]]


def test_graph_changes(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c")], "edge_id string, src string, dst string")
    left, edges = graph.detach_delete(n, e, n.filter("id = 'a'"))
    assert rows(left) == [("b",), ("c",)] and rows(edges) == [("2", "b", "c")]
    new = spark.createDataFrame([("3", "a", "c"), ("4", "a", "zzz")], "edge_id string, src string, dst string")
    assert rows(graph.upsert_edges(e, new, n).select("edge_id")) == [("1",), ("2",), ("3",)]


def test_merge_of_mentions(spark):
    m = spark.createDataFrame([(1, "c", "Electrical Power System", "SYSTEM", 0.7, 0.9, "ner", []), (2, "c", "Electrical power system", "SYSTEM", 0.7, 0.9, "ner", []), (3, "c", "EPS", "COMPONENT", 0.55, 1.0, "llm", ["electrical power system"])], "mention_id long, chunk_id string, name string, type string, confidence double, weight double, extractor string, aliases array<string>")
    r = candidates.merge_mentions(m, components).first()
    assert r.name == "EPS" and r.mention_count == 3 and r.type == "SYSTEM" and r.conflicting_types == ["COMPONENT"]


def test_validity(spark):
    known = spark.createDataFrame([("c", "Power Unit"), ("c", "Battery")], "chunk_id string, name string")
    r = spark.createDataFrame([("c", "Power Unit", "Battery", "CONTAINS", 0.8), ("c", "Power Unit", "", "CONTAINS", 0.8), ("c", "Power Unit", "Battery", "CONTAINS", 0.1), ("c", "Battery", "very important thing", "IS_A", 0.9), ("c", "Wheel", "Battery", "CONTAINS", 0.9), ("d", "Power Unit", "Battery", "CONTAINS", 0.9)], "chunk_id string, source string, target string, type string, confidence double")
    assert [x.reason for x in candidates.validity(r, known).orderBy("chunk_id", "source", "confidence", "target").collect()] .count(None) == 1
    assert {x.reason for x in candidates.validity(r, known, score=candidates.scores.edit_similarity).collect()} == {None, "missing_field", "low_confidence", "adjective_target", "unknown_source", "no_known_entities"}


def test_auto_merge(spark):
    c = spark.createDataFrame([("k1", "NASA", "ORG", 0.9, 10, ["National Agency"], "long text"), ("k2", "N.A.S.A.", "ORG", 0.95, 5, ["Agency"], "t"), ("k3", "SpaceX", "ORG", 0.5, 8, [], "s")], "candidate_key string, canonical_name string, candidate_type string, confidence_score double, mention_count long, aliases array<string>, description string").withColumn("status", F.lit("pending"))
    g = spark.createDataFrame([("k1", 1), ("k2", 1)], "candidate_key string, group int")
    got = {r.candidate_key: r for r in curate.merge(c, g).collect()}
    assert got["k1"].mention_count == 15 and got["k1"].aliases == ["Agency", "N.A.S.A.", "National Agency"] and got["k1"].description == "long text" and got["k1"].status == "approved"
    assert got["k2"].status == "rejected" and got["k3"].status == "pending"


def test_promotion(spark):
    t = spark.createDataFrame([("nasa", "e1", "approved"), ("jpl", "e2", "approved")], "raw_text string, canonical_id string, status string")
    r = spark.createDataFrame([("nasa:DEPENDS_ON:jpl", "NASA", "JPL", "DEPENDS_ON", 0.5, "pending"), ("x", "NASA", "Nobody", "DEPENDS_ON", 0.5, "pending")], "candidate_key string, source string, target string, type string, confidence_score double, status string")
    edges, after = curate.promote(r, t)
    assert rows(edges.select("src", "dst", "type")) == [("e1", "e2", "DEPENDS_ON")]
    assert rows(after.select("candidate_key", "status")) == [("nasa:DEPENDS_ON:jpl", "approved"), ("x", "pending")]


def test_reranking(spark):
    h = spark.createDataFrame([("q", "a", "power system", 0.9), ("q", "b", "power system", 0.89), ("q", "c", "battery voltage", 0.88)], "query_id string, chunk_id string, content string, score double")
    assert [r.chunk_id for r in vector.mmr(h, 0.5).orderBy("mmr_rank").collect()] == ["a", "c", "b"]
    got = {r.chunk_id: r for r in vector.diversify(h).collect()}
    assert got["a"].final_score == 0.9 and got["a"].diversity_score == 1.0 and got["c"].rank == 2 and got["b"].diversity_score == 0.0


def test_paging_and_norms(spark):
    h = spark.createDataFrame([("q", i, s) for i, s in enumerate((0.9, 0.7, 0.5))], "query_id string, id int, score double")
    n = {r.id: r.normalized for r in vector.normalize_scores(h).collect()}
    assert n[0] == 1.0 and n[2] == 0.0 and n[1] == pytest.approx(0.5)
    r = vector.rank(h, "score", "id")
    assert [x.has_more for x in vector.page(r, 2, 1).collect()] == [True, True] and [x.has_more for x in vector.page(r, 2, 2).collect()] == [False] and vector.page(r, 10, 2).count() == 0


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "A first paragraph that is long enough to be kept by the splitter, with well over one hundred characters in it.\n\nshort")], "doc_id long, text string")
    got = chunks.hierarchy(docs)
    assert rows(got.select("level", "path")) == [(1, "1"), (4, "1.1")]
    sec = spark.createDataFrame([(1, 1, 0, "Intro."), (1, 1, 1, "x" * 120)], "doc_id long, section int, subsection int, content string")
    assert rows(chunks.hierarchy(docs, sec).select("level", "path")) == [(1, "1"), (2, "1.1"), (3, "1.1.1"), (4, "1.1.1.1")]


def test_extraction(spark):
    t = spark.createDataFrame([("A solar panel is a type of power source.",), ("The OBC controls the power unit.",), ("The sun is bright today.",), ("",)], "text string")
    assert rows(extract.relationships(t).select("source", "target", "type")) == [("A solar panel", "power source", "IS_A"), ("The OBC", "the power unit", "CONTROLS")]
    assert rows(extract.verb_relationships(t).select("source", "target", "type")) == [("OBC", "power unit", "CONTROLS")]
    terms = spark.createDataFrame([("power unit", "COMPONENT", "gazetteer"), ("unit", "COMPONENT", "gazetteer")], "term string, type string, source string")
    got = extract.gazetteer(spark.createDataFrame([("c", "The power unit, system")], "chunk_id string, text string"), terms).collect()
    assert [(r.name, r.start_char, r.end_char) for r in got] == [("power unit", 4, 14)] and got[0].confidence == pytest.approx(0.92)


def test_acronyms(spark):
    t = spark.createDataFrame([("The Power Distribution Unit (PDU) works. A PDU (Protocol Data Unit) is sent. The Power Distribution Unit (PDU) again.",)], "text string")
    d = extract.acronym_dictionary(t)
    assert {(r.acronym, r.n) for r in d.collect()} >= {("PDU", 2), ("PDU", 1)}
    asked = spark.createDataFrame([("PDU", "the power distribution works")], "acronym string, context string")
    assert "Power Distribution Unit" in extract.resolve_acronyms(asked, d).first().expansion
    over = spark.createDataFrame([("PDU", "Override Unit")], "acronym string, expansion string")
    r = extract.resolve_acronyms(asked, d, over).first()
    assert r.expansion == "Override Unit" and r.confidence >= 0.95


def test_model_answers(spark):
    a = spark.createDataFrame([("c", 'Sure: {"entities": [{"text": "EPS", "entity_type": "system", "confidence": 3}], "relationships": [{"source": "A", "target": "B", "relationship_type": "part_of"}]} ok'), ("d", "none")], "chunk_id string, answer string")
    e, r = extract.parse_answers(a)
    assert rows(e.select("name", "type", "confidence")) == [("EPS", "SYSTEM", 1.0)] and rows(r.select("type", "confidence")) == [("PART_OF", 0.5)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nIntro.\n\n## Sub\n\nDetails.\n")
    (tmp_path / "b.txt").write_text("Plain first line\nmore")
    (tmp_path / "c.bin").write_text("no")
    p = [f"file://{tmp_path}"]
    assert files.find_files(spark, p).count() == 2
    docs = files.read_text(spark, p)
    assert {r.title for r in docs.collect()} == {"Title", "Plain first line"}
    got = files.sections(docs).orderBy("section", "subsection").collect()
    assert [(r.section, r.subsection, r.title, r.content.strip()) for r in got] == [(1, 0, "Title", "Intro."), (1, 1, "Sub", "Details.")]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("eps", "1", "EPS", ["E P S", "eps"], 0.9, 1)], "raw_text string, canonical_id string, canonical_name string, variants array<string>, confidence double, version int")
    for form in ("json", "csv"):
        sinks.write_normalization(t, f"{tmp_path}/{form}", form)
        assert rows(sinks.read_normalization(spark, f"{tmp_path}/{form}", form).select(*t.columns)) == rows(t)
    e = spark.createDataFrame([("A", "B", 4)], "left string, right string, n long")
    assert '"A" -- "B" [label=4, penwidth=2.00];' in sinks.dot(e)
    assert sinks.matrix(e).columns == ["row", "A", "B"]
    assert "| left | right | n |" in sinks.report({"edges": e}, "markdown") and "<td>A</td>" in sinks.report({"edges": e}, "html")


def test_embedding_cache(spark):
    t = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    got, full = sinks.embedding_cache(t, cache, udfs.hashed_embedding(16))
    assert full.count() == 2 and got.filter("vector is null").count() == 0


def test_commands(spark):
    c = commands.parse(":filter type=system confidence=0.9 eps")
    assert c.name == "filter" and c.args == ("eps",) and c.options == {"type": "system", "confidence": "0.9"}
    assert commands.validate(c, ("SYSTEM",)) == [] and len(commands.validate(commands.parse("f type=x status=y confidence=2"), ("SYSTEM",))) == 3
    assert commands.parse("approve >=0.9").args == (">=0.9",) and commands.step(0, -1, 3) == 2


def test_changes(spark):
    stored = spark.createDataFrame([(1, "/d/a", "a", "x"), (2, "/d/b", "b", "y"), (3, "/d/c", "c", "z"), (4, "/d/m", "m", "w"), (5, "/other/q", "q", "q"), (6, "/d/r1", "r1", "rr")], "document_id int, path string, filename string, checksum string")
    disk = spark.createDataFrame([("/d/a", "a", "x"), ("/d/b", "b", "Y"), ("/d/n", "n", "n"), ("/d/sub/m", "m", "w"), ("/d/r2", "r2", "rr")], "path string, filename string, checksum string")
    got = {r.path: r.status for r in updates.detect_changes(stored, disk, ["/d"]).collect()}
    assert got == {"/d/a": "unchanged", "/d/b": "modified", "/d/c": "deleted", "/d/n": "new", "/d/sub/m": "unchanged", "/d/r1": "deleted", "/d/r2": "new"}


def test_stream_upsert_equals_batch(spark, tmp_path):
    from graphloom.queries import mentions

    m = mentions(spark, "/root/testdata/sf0.001").drop("user_id", "candidate_type", "canonical_name")
    for i in range(3):
        m.filter(F.col("candidate_key").isNotNull() & (F.pmod(F.xxhash64("chunk_ids"), F.lit(3)) == i)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = updates.upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.read.parquet(f"{tmp_path}/store/v2")) == rows(candidates.aggregate(m))


def test_incremental_equals_batch(spark):
    from graphloom.queries import mentions

    m = mentions(spark, "/root/testdata/sf0.001").drop("user_id", "candidate_type", "canonical_name")
    a = candidates.aggregate(m.filter("candidate_key like 'V%'"))
    assert rows(candidates.upsert(a, m.filter("candidate_key not like 'V%'"))) == rows(candidates.aggregate(m))
