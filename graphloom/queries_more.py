"""Named queries for the remaining operators of the library. They register themselves beside those of graphloom.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scores
from graphloom.functions import text as X
from graphloom.operators import candidates as C
from graphloom.operators import chunks, cleaning, curate, extract, graph, vector
from graphloom.operators import discover as D
from graphloom.operators.components import components
from graphloom.plans import commands, retrieval
from graphloom.queries import CAND, COS, EDGES, ORACLE_SQL, PAIR, PAIRS, TOP, _names, _pairs, _records, _top, asked, candidate_rows, edges, mentions, pairs_of_parts, points, query, r6
from graphloom.session import table
from graphloom.sources import files
from graphloom.streaming import lifecycle, updates

# --- joins ------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS id, c_name AS n, ['pending', 'approved', 'rejected'][CAST(c_custkey % 3 AS INT) + 1] AS status FROM customer),
w AS (SELECT CASE id % 20 WHEN 0 THEN upper(n) WHEN 1 THEN 'ALIAS ' || id WHEN 2 THEN 'cust_' || id ELSE 'nobody ' || id END AS name, CASE WHEN id % 20 < 3 THEN id END AS id FROM c WHERE id % 20 < 4)
SELECT name, w.id, status FROM w LEFT JOIN c USING (id)""")
def j3_peer_matches(spark, d):
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    entities = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("CUSTOMER:cust_"), key).alias("candidate_key"), F.col("c_name").alias("canonical_name"), F.array(F.concat(F.lit("alias "), key)).alias("aliases"), F.element_at(F.array(*map(F.lit, ("pending", "approved", "rejected"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("status"))
    name = F.when(F.col("c_custkey") % 20 == 0, F.upper("c_name")).when(F.col("c_custkey") % 20 == 1, F.concat(F.lit("ALIAS "), key)).when(F.col("c_custkey") % 20 == 2, F.concat(F.lit("cust_"), key)).otherwise(F.concat(F.lit("nobody "), key))
    return D.peer_matches(c.filter("c_custkey % 20 < 4").select(name.alias("name")), entities)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j5_chunks_by_id(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    return chunks.fetch(rows, table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"))).select(F.col("chunk_id").alias("doc_id"), "lang")


@query(f"WITH {PAIR} SELECT l AS part_a, r AS part_b, n, round(log2(n / t / ((a.f / t) * (b.f / t))), 6) AS pmi FROM co JOIN fr a ON a.key = l JOIN fr b ON b.key = r, tot")
def j10_cooccurrence(spark, d):
    return D.cooccurrence(pairs_of_parts(spark, d), 2, None, 0).select(F.col("left").alias("part_a"), F.col("right").alias("part_b"), "n", r6("pmi"))


@query("SELECT '/' || CASE doc_id % 4 WHEN 0 THEN 'b' ELSE 'a' END || '/' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'modified' ELSE 'deleted' END AS status FROM documents")
def j13_moved_files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"), F.md5(F.coalesce("text", F.lit(""))).alias("sum"))
    stored = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("/a/"), "k").alias("path"), F.concat(F.lit("f"), "k").alias("filename"), F.col("sum").alias("checksum"))
    disk = docs.filter("doc_id % 4 <> 3").select(F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("/b/")).otherwise(F.lit("/a/")), "k").alias("path"), F.concat(F.lit("f"), "k").alias("filename"), F.when(F.col("doc_id") % 4 == 2, F.lit("new")).otherwise(F.col("sum")).alias("checksum"))
    return updates.detect_changes(stored, disk, ["/a", "/b"]).select("path", "status")


@query(f"WITH {EDGES} SELECT edge_id, src AS at, dst AS towards FROM e WHERE type = 'PART_OF' UNION ALL SELECT edge_id, dst, src FROM e WHERE type = 'PART_OF'")
def j14_steps(spark, d):
    return graph.steps(edges(spark, d), ["PART_OF"], "both").select("edge_id", "at", F.col("to").alias("towards"))


@query(f"""WITH {CAND}, w AS (SELECT * FROM cand WHERE user_id % 20 = 0), s AS (SELECT w.candidate_key AS source, c.candidate_key AS target, CASE WHEN w.alias = c.alias THEN 1.0 ELSE 1 - levenshtein(lower(w.canonical_name), lower(c.canonical_name)) / greatest(length(w.canonical_name), length(c.canonical_name)) END AS score,
CASE WHEN w.alias = c.alias THEN 'shared_alias' ELSE 'similar_name' END AS reason FROM w JOIN cand c ON w.candidate_key <> c.candidate_key), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, target) AS rank FROM s WHERE reason = 'shared_alias' OR score > 0.7)
SELECT source, target, round(score, 6) AS score, reason, rank FROM k WHERE rank <= 5""")
def j16_duplicate_suggestions(spark, d):
    rows = candidate_rows(spark, d)
    wanted = rows.filter(F.element_at(F.split("candidate_key", "_"), -1).cast("long") % 20 == 0)
    return curate.duplicate_suggestions(wanted, rows, score=scores.edit_similarity).select("source", "target", r6("score"), "reason", F.col("rank").cast("long").alias("rank"))


# --- graph ------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {PAIRS}, und AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), walk(node, other) AS (SELECT a, a FROM und UNION SELECT w.node, u.b FROM walk w JOIN und u ON w.other = u.a)
SELECT node, min(other) AS component FROM walk GROUP BY node""")
def g14_similarity_clusters(spark, d):
    return components(_pairs(spark, d))


@query("SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def g19_document_chunks(spark, d):
    c = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("document_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("level"), F.col("doc_id").cast("string").alias("path"))
    return chunks.of_document(c, "src1").select("doc_id", "lang")


@query(f"WITH {CAND}, g AS (SELECT *, user_id % 50 AS grp FROM cand), s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mention_count DESC, length(canonical_name) DESC, candidate_key DESC) AS r FROM g) SELECT candidate_key, grp AS survivor_of FROM s WHERE r = 1")
def g15_survivors(spark, d):
    rows = candidate_rows(spark, d)
    user = F.element_at(F.split("candidate_key", "_"), -1).cast("long")
    return C.merge_groups(rows, rows.select("candidate_key", (user % 50).alias("group"))).select("candidate_key", (user % 50).alias("survivor_of"))


# --- aggregations -----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (l_linenumber % 3 = 0) AS pending, count(*) FILTER (l_linenumber % 3 = 1) AS approved, count(*) FILTER (l_linenumber % 3 = 2) AS rejected FROM lineitem")
def a4_relationship_status(spark, d):
    state = F.element_at(F.array(*map(F.lit, ("pending", "approved", "rejected"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return C.status_counts(table(spark, d, "lineitem").select(state.alias("status")))


@query("""WITH m AS (SELECT user_id AS chunk_id, 'Part ' || (event_id % 7) AS name, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'ner' END AS extractor, (event_id % 5) / 10 * CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.9 END AS c FROM events)
SELECT chunk_id, name, count(*) AS mention_count, round(least(1, 1 - product(1 - c) + CASE WHEN count(DISTINCT extractor) >= 2 THEN 0.05 ELSE 0 END), 6) AS confidence FROM m GROUP BY 1, 2""")
def a12_merged_mentions(spark, d):
    even = F.col("event_id") % 2 == 0
    m = table(spark, d, "events").select(F.col("event_id").cast("long").alias("mention_id"), F.col("user_id").alias("chunk_id"), F.concat(F.lit("Part "), (F.col("event_id") % 7).cast("string")).alias("name"), F.lit("PART").alias("type"), ((F.col("event_id") % 5) / 10).alias("confidence"), F.when(even, 1.0).otherwise(0.9).alias("weight"), F.when(even, "llm").otherwise("ner").alias("extractor"), F.array().cast("array<string>").alias("aliases"))
    return C.merge_mentions(m, components).select("chunk_id", "name", "mention_count", r6("confidence"))


@query("SELECT strftime(ts, '%Y-%m-%d') || '|' || upper(event_type) || ':user_' || user_id AS document_key, CAST(count(*) AS BIGINT) AS mention_count, round(max(greatest(0, least(1, value / 100))), 6) AS confidence_score FROM events GROUP BY 1")
def a13_document_candidates(spark, d):
    rows = mentions(spark, d).withColumn("document_key", F.concat_ws("|", F.get("source_documents", F.lit(0)), "candidate_key"))
    return C.aggregate(rows, "document_key").select("document_key", "mention_count", r6("confidence_score"))


@query(f"""WITH {CAND}, g AS (SELECT *, user_id % 50 AS grp FROM cand) SELECT max_by(candidate_key, struct_pack(a := mention_count, b := length(canonical_name), c := candidate_key)) AS candidate_key, round(max(confidence_score), 6) AS confidence_score,
CAST(sum(mention_count) AS BIGINT) AS mention_count, CAST(2 * count(DISTINCT user_id) - 1 AS BIGINT) AS n_aliases FROM g GROUP BY grp""")
def a14_merge_aggregation(spark, d):
    rows = candidate_rows(spark, d)
    groups = rows.select("candidate_key", (F.element_at(F.split("candidate_key", "_"), -1).cast("long") % 50).alias("group"))
    return C.merge_groups(rows, groups).select("candidate_key", r6("confidence_score"), "mention_count", F.size("aliases").cast("long").alias("n_aliases"))


@query("SELECT doc_id, length(coalesce(text, '')) AS original_length, length(coalesce(text, '')) // 2 AS cleaned_length, round(CASE WHEN length(coalesce(text, '')) > 0 THEN 100.0 * (length(text) - length(text) // 2) / length(text) ELSE 0 END, 6) AS removal_percentage, len(string_split(coalesce(text, ''), chr(10))) AS original_lines FROM documents")
def a16_cleaning_statistics(spark, d):
    body = F.coalesce("text", F.lit(""))
    half = table(spark, d, "documents").withColumn("cleaned", F.substr(body, F.lit(1), F.floor(F.length(body) / 2).cast("int")))
    return cleaning.statistics(half).select("doc_id", "original_length", "cleaned_length", r6("removal_percentage"), "original_lines")


@query(f"WITH {CAND} SELECT status, count(*) AS n FROM cand GROUP BY 1")
def a21_status_statistics(spark, d):
    return C.type_counts(candidate_rows(spark, d), "status")


@query("SELECT 'documents' AS counter, count(*) AS n FROM documents UNION ALL SELECT 'characters', CAST(sum(length(coalesce(text, ''))) AS BIGINT) FROM documents")
def a22_run_counters(spark, d):
    rows, seen = lifecycle.counted(table(spark, d, "documents"), "documents", documents=F.count(F.lit(1)), characters=F.sum(F.length(F.coalesce("text", F.lit("")))))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(seen.get.items()), "counter string, n long")


# --- ranking and sets -------------------------------------------------------------------------------------------------


@query(f"WITH {TOP} SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), point_id) AS rank FROM top")
def w2_rank(spark, d):
    return vector.rank(_top(spark, d).select("query_id", "point_id", (-F.col("score")).alias("distance")), "distance", "point_id").select("query_id", "point_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH hit AS (SELECT a.vec_id AS query_id, b.vec_id AS point_id, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND b.vec_id % 4 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, point_id) AS rank FROM hit WHERE score >= 0.05),
t AS (SELECT *, max(rank) OVER w > 10 AS has_more, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-10 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normalized FROM r WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id))
SELECT query_id, point_id, round(score, 6) AS score, round(normalized, 6) AS normalized, rank, has_more FROM t WHERE rank BETWEEN 6 AND 10""")
def w11_search_page(spark, d):
    p = points(spark, d).select(F.col("vec_id").alias("point_id"), "vector", (F.col("vec_id") % 4 + 1).cast("int").alias("level"), F.col("label").cast("string").alias("content"))
    return vector.search(asked(spark, d), p, 20, 0.05, level=2, number=2, size=5).select("query_id", "point_id", r6("score"), r6("normalized"), F.col("rank").cast("long").alias("rank"), "has_more")


@query(f"SELECT a, b, confidence, CASE kind WHEN 'copy' THEN 'copy' ELSE 'fuzzy' END AS method FROM ({ORACLE_SQL['j8_blocked_fuzzy']}) UNION ALL SELECT a, b, confidence, 'semantic' FROM ({ORACLE_SQL['t31_dedup_score']})")
def u1_suggestions(spark, d):
    return D.union_suggestions(D.fuzzy_classes(_names(spark, d), 0.70, score=scores.edit_similarity), D.semantic_pairs(_pairs(spark, d), _records(spark, d))).select("a", "b", r6("confidence"), "method")


@query("SELECT l_orderkey AS chunk_id, l_partkey AS source, l_suppkey AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'llm' ELSE 'pattern' END AS source_extractor FROM lineitem")
def u2_union_relationships(spark, d):
    l = table(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))  # noqa: E741
    return extract.union_relationships(l.filter("l_linenumber % 2 = 0"), l.filter("l_linenumber % 2 <> 0")).select("chunk_id", "source", "target", "source_extractor")


@query("SELECT DISTINCT l_orderkey AS chunk_id, 'part ' || (l_partkey % 9) AS name FROM lineitem")
def u2_union_known(spark, d):
    l = table(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("part "), (F.col("l_partkey") % 9).cast("string")).alias("name"))  # noqa: E741
    return extract.union_known(l.filter("l_linenumber % 2 = 0"), l.filter("l_linenumber % 2 <> 0"), l.filter("l_linenumber = 1"))


@query(r"WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '\d+(?:\.\d+)?')) AS a, regexp_extract_all(substr(coalesce(text, ''), 1, length(coalesce(text, '')) // 3), '\d+(?:\.\d+)?') AS b FROM documents) SELECT doc_id, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n_lost FROM t")
def u3_numbers_lost(spark, d):
    body = F.coalesce("text", F.lit(""))
    third = F.substr(body, F.lit(1), F.floor(F.length(body) / 3).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_except(X.numbers_of(body), X.numbers_of(third))).cast("long").alias("n_lost"))


@query("""WITH c AS (SELECT l_orderkey AS chunk_id, l_orderkey % 10 AS query_id, list_distinct(list(l_partkey % 20)) AS e FROM lineitem GROUP BY 1, 2) SELECT chunk_id, round(len(list_filter(e, lambda x: x % 10 = query_id OR x = 3)) / CASE WHEN query_id % 10 = 3 THEN 2 ELSE 3 END, 6) AS entity_coverage_score FROM c""")
def u4_coverage(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") % 10).alias("query_id")).agg(F.collect_set(F.col("l_partkey") % 20).alias("entity_ids"))
    wanted = spark.range(10).select(F.col("id").alias("query_id"), F.array_distinct(F.array(F.col("id"), F.col("id") + 10, F.lit(3).cast("long"))).alias("entity_ids"))
    return retrieval.coverage(c, wanted).select("chunk_id", r6("entity_coverage_score"))


@query(f"WITH {PAIRS} SELECT a, b, round(greatest(0, least(1, 0.7 * s + 0.2 * fit + 0.1 * least(1, least(a % 4, b % 4) / 2))), 6) AS confidence FROM pr")
def u6_semantic_suggestions(spark, d):
    return D.semantic_pairs(_pairs(spark, d), _records(spark, d)).orderBy(F.desc("confidence"), F.desc("similarity"), "a", "b").select("a", "b", r6("confidence"))


@query("""WITH l AS (SELECT l_orderkey % 50 AS query_id, row_number() OVER () AS p, l_discount AS score, l_partkey AS a, l_suppkey AS b FROM lineitem), n AS (SELECT query_id, p, score, a % 40 AS chunk_id FROM l UNION SELECT query_id, p, score, b % 40 FROM l)
SELECT query_id, chunk_id, round(avg(score), 9) AS graph_score FROM n GROUP BY 1, 2""")
def h3_graph_chunk_scores(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    paths = l.select((F.col("l_orderkey") % 50).alias("query_id"), F.array(part, supplier).alias("nodes"), F.col("l_discount").alias("score"))
    held = l.select(part.alias("node"), (F.col("l_partkey") % 40).alias("chunk_id")).distinct().union(l.select(supplier.alias("node"), (F.col("l_suppkey") % 40).alias("chunk_id")).distinct())
    return retrieval.graph_chunk_scores(paths, held).select("query_id", "chunk_id", F.round("graph_score", 9).alias("graph_score"))


# --- curation and commands --------------------------------------------------------------------------------------------


@query(f"WITH {CAND} SELECT candidate_key, CASE WHEN user_id % 10 = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN candidate_key = 'VIEW:user_1' THEN 'Edited' ELSE canonical_name END AS canonical_name FROM cand")
def c2_reject_edit(spark, d):
    rows = candidate_rows(spark, d)
    out = rows.filter(F.element_at(F.split("candidate_key", "_"), -1).cast("long") % 10 == 0)
    return curate.edit(curate.set_status(rows, out, "rejected"), "VIEW:user_1", canonical_name="Edited").select("candidate_key", "status", "canonical_name")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'inactive' ELSE 'active' END AS status FROM documents")
def c8_status_update(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit("active").alias("status"))
    return curate.set_status(rows, table(spark, d, "labels").filter("quality = 0"), "inactive", "doc_id")


@query(f"WITH {CAND} SELECT candidate_key FROM cand WHERE status = 'approved' AND candidate_type = 'VIEW' AND confidence_score >= 0.5")
def f17_filter_command(spark, d):
    return commands.apply(candidate_rows(spark, d), commands.parse(":filter type=view status=approved confidence=0.5")).select("candidate_key")


@query("SELECT event_id FROM events WHERE upper(event_type) IN ('VIEW', 'CLICK')")
def f10_allowed_types(spark, d):
    return C.allowed_types(table(spark, d, "events").select("event_id", F.col("event_type").alias("type")), ["view", "Click"]).select("event_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src3', 'src4') ORDER BY doc_id % 4, CAST(doc_id AS VARCHAR) LIMIT 100")
def f13_first_hundred(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 4).alias("level"), F.col("doc_id").cast("string").alias("path"), F.array("source", "lang").alias("entity_ids"))
    return chunks.mentioning(c, ["src3", "src4"]).select(F.col("chunk_id").alias("doc_id"))


# --- scalars and sources ----------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS x, p_brand AS y, least(0.99, CASE WHEN least(length(p_name), length(p_brand)) < 4 THEN 0.96 WHEN least(length(p_name), length(p_brand)) < 8 THEN 0.92 ELSE 0.9 END) AS t, (p_size % 10) / 10 AS s FROM part)
SELECT id, round(greatest(0, least(1, s - 0.25 * least(abs(length(x) - length(y)) / greatest(length(x), length(y), 1), 0.4) + greatest(0, s - t))), 6) AS confidence FROM t""")
def t13_fuzzy_confidence(spark, d):
    x, y = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(scores.fuzzy_confidence((F.col("p_size") % 10) / 10, scores.fuzzy_threshold(x, y), x, y), "confidence"))


@query("SELECT DISTINCT 'PDU ' || p_name AS name, 'Power Distribution Unit|Power Distribution Unit ' || p_name AS aliases FROM part")
def t16_alias_enrichment(spark, d):
    dictionary = spark.createDataFrame([("PDU", "Power Distribution Unit", 3), ("PDU", "Protocol Data Unit", 1)], "acronym string, expansion string, n int")
    rows = table(spark, d, "part").select(F.concat(F.lit("PDU "), "p_name").alias("name")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    return extract.enrich_aliases(rows, dictionary).select("name", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT p_partkey AS id, p_name AS name, upper(p_type) AS type, round(greatest(0, least(1, p_size / 40)), 6) AS confidence FROM part")
def t21_model_answers(spark, d):
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("text"), F.col("p_type").alias("entity_type"), (F.col("p_size") / 40).alias("confidence"))).alias("entities")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Here it is: "), body, F.lit(" as asked.")).alias("answer"))
    return extract.parse_answers(rows)[0].select("id", "name", "type", r6("confidence"))


@query("SELECT doc_id, s.section, s.subsection, s.title, s.content FROM documents, (VALUES (1, 0, 'A', 'x'), (1, 1, 'B', 'y' || chr(10) || '### c' || chr(10) || 'z'), (2, 0, 'D', 'w')) AS s(section, subsection, title, content)")
def src3_sections(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit("markdown").alias("source_type"), F.lit("f.md").alias("filename"), F.lit("intro\n# A\nx\n## B\ny\n### c\nz\n# D\nw").alias("content"))
    return files.sections(rows, "doc_id").select("doc_id", F.col("section").cast("int").alias("section"), F.col("subsection").cast("int").alias("subsection"), "title", "content")
