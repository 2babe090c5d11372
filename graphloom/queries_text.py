"""More named queries: extraction, question reading, updates. They register themselves beside those of graphloom.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import questions as Q
from graphloom.functions import scores
from graphloom.functions import text as X
from graphloom.operators import candidates as C
from graphloom.operators import chunks, curate, extract, graph
from graphloom.plans import commands
from graphloom.queries import CAND, EDGES, QSQL, _CONV, _INTENT, _TYPES, _ends, _starts, _walk_sql, _worded_sql, asked_questions, candidate_rows, edges, query, r6, worded
from graphloom.session import table
from graphloom.streaming import updates

SENTENCES = (
    "A solar panel is a type of power source.", "The OBC controls the power unit.", "The sun is bright today.", "The bus comprises many small modules, including heaters and pumps",
    "The Power Distribution Unit (PDU) powers the payload. A PDU (Protocol Data Unit) is sent.", "The radiator is a component of the thermal system", "Pumps and valves such as the main valve", "The Attitude Control System (ACS) monitors the star tracker; version: 2.4 of 2021-03-04",
)


def _sentences(spark, d):
    """The documents, and a sentence about each part."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).union(worded(spark, d, SENTENCES, "part", "p_partkey", "p_name"))


SSQL = f"s AS (SELECT CAST(doc_id AS BIGINT) AS id, coalesce(text, '') AS text FROM documents UNION ALL {_worded_sql(SENTENCES, 'part', 'p_partkey', 'p_name')})"
_REL = " UNION ALL ".join(
    f"SELECT id, '{k}' AS type, unnest(regexp_extract_all(text, '(?i)([A-Za-z0-9 _-]+){w}([A-Za-z0-9 _-]+)', {1 if fwd else 2})) AS source, unnest(regexp_extract_all(text, '(?i)([A-Za-z0-9 _-]+){w}([A-Za-z0-9 _-]+)', {2 if fwd else 1})) AS target FROM s" for k, w, fwd in extract.CONNECTIVES
)


@query(f"WITH s AS (SELECT id, q AS text FROM ({_worded_sql(SENTENCES, 'part', 'p_partkey', 'p_name')})), r AS ({_REL}) SELECT DISTINCT id, type, trim(source) AS source, trim(target) AS target FROM r WHERE length(trim(source)) BETWEEN 1 AND 50 AND length(trim(target)) BETWEEN 1 AND 50 AND lower(trim(source)) <> lower(trim(target))")
def t17_pattern_relationships(spark, d):
    return extract.relationships(worded(spark, d, SENTENCES, "part", "p_partkey", "p_name").toDF("id", "text")).select("id", "type", "source", "target")


_AC = (r"\b((?:[A-Z][A-Za-z-]+ ){1,5}[A-Z][A-Za-z-]+) \(([A-Z]{2,8})\)", r"\b([A-Z]{2,8}) \(((?:[A-Z][A-Za-z-]+ ){1,5}[A-Z][A-Za-z-]+)\)")


@query(f"WITH {SSQL} SELECT id, unnest(regexp_extract_all(text, '{_AC[0]}', 2)) AS acronym, unnest(regexp_extract_all(text, '{_AC[0]}', 1)) AS expansion FROM s UNION ALL SELECT id, unnest(regexp_extract_all(text, '{_AC[1]}', 1)), unnest(regexp_extract_all(text, '{_AC[1]}', 2)) FROM s")
def t14_acronyms(spark, d):
    return _sentences(spark, d).select("id", F.explode(X.acronym_definitions(F.col("text"))).alias("a")).select("id", "a.acronym", "a.expansion")


@query(f"WITH {SSQL}, a AS (SELECT unnest(regexp_extract_all(text, '{_AC[0]}', 2)) AS acronym, unnest(regexp_extract_all(text, '{_AC[0]}', 1)) AS expansion FROM s UNION ALL SELECT unnest(regexp_extract_all(text, '{_AC[1]}', 1)), unnest(regexp_extract_all(text, '{_AC[1]}', 2)) FROM s) SELECT acronym, expansion, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY acronym), 6) AS share FROM a GROUP BY 1, 2")
def a19_acronym_dictionary(spark, d):
    return extract.acronym_dictionary(_sentences(spark, d)).select("acronym", "expansion", "n", r6("share"))


_VERSION = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in X.VERSION_PATTERNS) + ")"
_DATE = "coalesce(" + ", ".join(f"strftime(try_strptime(nullif(regexp_extract(text, '{p}', 1), ''), '{f}'), '%Y-%m-%d')" for (p, _), f in zip(X.DATE_PATTERNS, ("%Y-%m-%d", "%m/%d/%Y"))) + ")"


@query(f"SELECT doc_id, {_VERSION} AS version, {_DATE} AS date FROM documents")
def src7_version_date(spark, d):
    return table(spark, d, "documents").select("doc_id", X.version_of(F.col("text")).alias("version"), X.date_of(F.col("text")).alias("date"))


@query("""WITH r AS (SELECT l_orderkey AS chunk_id, 'part ' || l_partkey AS source, 'supplier ' || l_suppkey AS target, CASE l_linenumber % 4 WHEN 0 THEN 'IS_A' WHEN 1 THEN '' ELSE 'CONTAINS' END AS type, l_discount * 10 AS confidence FROM lineitem),
k AS (SELECT l_orderkey AS chunk_id, 'part ' || l_partkey AS name FROM lineitem UNION SELECT l_orderkey, 'supplier ' || l_suppkey FROM lineitem WHERE l_quantity > 10), h AS (SELECT DISTINCT chunk_id FROM k)
SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM (SELECT CASE WHEN type = '' THEN 'missing_field' WHEN confidence < 0.5 THEN 'low_confidence'
 WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.chunk_id = r.chunk_id AND 1 - levenshtein(k.name, r.source) / greatest(length(k.name), length(r.source)) >= 0.95) THEN 'unknown_source'
 WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.chunk_id = r.chunk_id AND 1 - levenshtein(k.name, r.target) / greatest(length(k.name), length(r.target)) >= 0.95) THEN 'unknown_target' END AS reason FROM r) GROUP BY 1""")
def f9_validation(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    name = lambda k, c: F.concat(F.lit(f"{k} "), F.col(c).cast("string"))
    kind = F.when(F.col("l_linenumber") % 4 == 0, "IS_A").when(F.col("l_linenumber") % 4 == 1, "").otherwise("CONTAINS")
    r = l.select(F.col("l_orderkey").alias("chunk_id"), name("part", "l_partkey").alias("source"), name("supplier", "l_suppkey").alias("target"), kind.alias("type"), (F.col("l_discount") * 10).alias("confidence"))
    known = l.select(F.col("l_orderkey").alias("chunk_id"), name("part", "l_partkey").alias("name")).unionByName(l.filter("l_quantity > 10").select(F.col("l_orderkey").alias("chunk_id"), name("supplier", "l_suppkey").alias("name")))
    return C.validity(r, known, cutoff=0.95, score=scores.edit_similarity).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH r AS (SELECT doc_id AS id, coalesce(text, '') AS a, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN regexp_replace(coalesce(text, ''), '\\d+', '', 'g') WHEN 2 THEN lower(coalesce(text, '')) ELSE substr(coalesce(text, ''), 1, CAST(length(coalesce(text, '')) // 3 AS INT)) END AS b FROM documents) SELECT id, CASE WHEN len(list_filter(regexp_extract_all(a, '\\d+(?:\\.\\d+)?'), lambda x: NOT list_contains(regexp_extract_all(b, '\\d+(?:\\.\\d+)?'), x))) > 0 THEN 'rejected:missing_numbers' WHEN len(list_filter(list_filter(regexp_split_to_array(a, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')), lambda x: NOT list_contains(list_filter(regexp_split_to_array(b, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')), x))) > 0 THEN 'rejected:missing_acronyms' WHEN length(a) > 400 AND length(b) < 0.4 * length(a) THEN 'rejected:too_short' ELSE 'accepted' END AS verdict FROM r")
def t22_rewrite_check(spark, d):
    """Each document against what one of four careless rewrites leaves of it."""
    a = F.coalesce("text", F.lit(""))
    b = F.when(F.col("doc_id") % 4 == 0, a).when(F.col("doc_id") % 4 == 1, F.regexp_replace(a, r"\d+", "")).when(F.col("doc_id") % 4 == 2, F.lower(a)).otherwise(F.substr(a, F.lit(1), F.floor(F.length(a) / 3).cast("int")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.rewrite_verdict(a, b).alias("verdict"))


@query("""SELECT p_partkey AS id, round(greatest(0, least(1, 0.72 + least(length(p_name) / 50, 0.10) + CASE WHEN regexp_matches(p_type || ' unit', '(?i)system|subsystem|module|unit|procedure|mode') THEN 0.05 ELSE 0 END
 + CASE WHEN p_size % 2 = 0 THEN 0.05 ELSE 0 END - CASE WHEN regexp_matches(p_name, '\\d') THEN 0.05 ELSE 0 END)), 6) AS score FROM part""".replace("\\\\", "\\"))
def t20_mention_score(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, "SYSTEM").otherwise("CONCEPT")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(scores.mention_score(F.col("p_name"), kind, F.lit("gazetteer"), F.concat("p_type", F.lit(" unit"))), "score"))


@query("SELECT p_partkey AS id, round(CASE WHEN least(length(p_name), length(p_brand)) < 4 THEN 0.96 WHEN least(length(p_name), length(p_brand)) < 8 THEN 0.92 ELSE 0.90 END::DOUBLE, 6) AS threshold FROM part")
def t12_threshold(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(scores.fuzzy_threshold(F.col("p_name"), F.col("p_brand")), "threshold"))


_REST = "regexp_replace(n, '^\\s*\\S+\\s*', '')"
_MENT = f"list_distinct(regexp_extract_all({_REST}, '[A-Z][A-Za-z0-9-]*(?: [A-Z][A-Za-z0-9-]*)*'))"


@query(f"WITH {QSQL}, {_INTENT} SELECT id, CASE WHEN intent = 'semantic' AND len({_MENT}) = 0 THEN 'vector_only' WHEN intent = 'structural' AND len({_MENT}) > 0 THEN 'graph_first' WHEN intent = 'procedural' THEN 'graph_first' ELSE 'hybrid_parallel' END AS strategy FROM q4")
def h1_strategy(spark, d):
    q = asked_questions(spark, d).withColumn("kind", Q.intent(F.col("q"))["intent"])
    return q.select("id", Q.strategy(F.col("kind"), F.size(Q.mentions(F.col("q"))), F.lit(True)).alias("strategy"))


@query(f"WITH {QSQL}, t AS (SELECT id, {_TYPES} AS t, len({_MENT}) AS m FROM q1) SELECT id, CASE WHEN list_contains(t, 'PRECEDES') THEN 'sequential' WHEN list_contains(t, 'REFERENCES') THEN 'procedural' WHEN list_contains(t, 'CONTAINS') OR list_contains(t, 'PART_OF') THEN 'hierarchical' WHEN m >= 2 THEN 'shortest_path' ELSE 'multi_hop' END AS strategy FROM t")
def g10_graph_strategy(spark, d):
    return asked_questions(spark, d).select("id", Q.graph_strategy(Q.relationship_types(F.col("q")), F.size(Q.mentions(F.col("q")))).alias("strategy"))


_STOP = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)


@query(f"WITH {QSQL} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(n), '[a-z][a-z0-9-]{{2,}}'), lambda w: w NOT IN ({_STOP})))), ',') AS keywords FROM q1")
def t26_keywords(spark, d):
    return asked_questions(spark, d).select("id", F.array_join(F.array_sort(Q.keywords(F.col("q"))), ",").alias("keywords"))


@query(f"WITH {QSQL} " + " UNION ALL ".join(f"SELECT id, '{t}' AS term, '{','.join(s)}' AS synonyms FROM q1 WHERE regexp_matches(lower(n), '\\b{t}\\b')" for t, s in Q.SYNONYMS))
def t25_expansion(spark, d):
    return asked_questions(spark, d).select("id", F.explode(Q.expansions(F.col("q"))).alias("e")).select("id", "e.term", F.array_join("e.synonyms", ",").alias("synonyms"))


@query(f"WITH {_CONV} SELECT count(*) FILTER (len(regexp_split_to_array(trim(q), '\\s+')) >= 2) AS valid, count(*) AS total FROM q1")
def f15_valid_questions(spark, d):
    q = table(spark, d, "conversations").filter("role = 'user'").select(F.coalesce("text", F.lit("")).alias("q"))
    return q.agg(F.count_if(Q.is_valid(F.col("q"))).alias("valid"), F.count(F.lit(1)).alias("total"))


@query("WITH c AS (SELECT doc_id AS chunk_id, source AS document_id, doc_id % 4 + 1 AS level FROM documents), o AS (SELECT *, CASE level WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 4 END AS k FROM c) SELECT chunk_id FROM (SELECT *, min(k) OVER (PARTITION BY document_id) AS m FROM o) WHERE k = m")
def f11_extraction_level(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("level"))
    return C.extraction_level(c).select("chunk_id")


@query("WITH p AS (SELECT DISTINCT source || '/' || lang AS k, lower(split_part(text, ' ', 1)) AS name FROM documents WHERE length(split_part(text, ' ', 1)) > 4) SELECT doc_id AS chunk_id, name FROM documents JOIN p ON k = source || '/' || lang AND contains(lower(text), name)")
def j11_propagation(spark, d):
    docs = table(spark, d, "documents").withColumn("k", F.concat_ws("/", "source", "lang"))
    first = F.split_part("text", F.lit(" "), F.lit(1))
    parents = docs.filter(F.length(first) > 4).select(F.col("k").alias("chunk_id"), F.lower(first).alias("name")).distinct().withColumn("aliases", F.array().cast("array<string>"))
    return C.propagate(parents, docs.select(F.col("doc_id").alias("chunk_id"), F.col("k").alias("parent_chunk_id"), F.col("text").alias("content"))).select("chunk_id", "name")


@query("WITH r AS (SELECT l_orderkey AS c, 'p' || l_partkey AS n, l_discount AS x FROM lineitem UNION ALL SELECT l_orderkey, 's' || l_suppkey, l_discount FROM lineitem), k AS (SELECT DISTINCT l_orderkey AS c, 'p' || l_partkey AS n FROM lineitem WHERE l_quantity > 25) SELECT c AS chunk_id, n AS name, round(max(x) * 0.8, 6) AS confidence FROM r ANTI JOIN k USING (c, n) GROUP BY 1, 2")
def j15_discovered_entities(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    r = l.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_discount").alias("confidence"))
    known = l.filter("l_quantity > 25").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"))
    return C.discovered(r, known).select("chunk_id", "name", r6("confidence"))


def _ends_sql(types: str, start: str) -> str:
    """Ends of trails of 1 to 3 edges, both ways: the third step counts over trails, as there are too many to list with their edges."""
    return f"""WITH {EDGES}, s AS (SELECT edge_id, src AS a, dst AS b FROM e WHERE type IN ({types}) UNION ALL SELECT edge_id, dst, src FROM e WHERE type IN ({types})),
t1 AS (SELECT a AS start_id, b AS end_id, edge_id AS e1 FROM s WHERE {start}), t2 AS (SELECT start_id, s.b AS end_id, e1, s.edge_id AS e2 FROM t1 JOIN s ON end_id = s.a WHERE e1 <> s.edge_id),
n2 AS (SELECT start_id, end_id, count(*) AS n FROM t2 GROUP BY 1, 2), u2 AS (SELECT start_id, end_id, edge_id, count(*) AS n FROM (SELECT start_id, end_id, unnest([e1, e2]) AS edge_id FROM t2) GROUP BY 1, 2, 3),
t3 AS (SELECT n2.start_id, s.b AS end_id FROM n2 JOIN s ON n2.end_id = s.a LEFT JOIN u2 ON u2.start_id = n2.start_id AND u2.end_id = n2.end_id AND u2.edge_id = s.edge_id WHERE coalesce(u2.n, 0) < n2.n)
SELECT DISTINCT start_id, end_id, 1 AS length FROM t1 UNION ALL SELECT start_id, end_id, 2 FROM n2 UNION ALL SELECT DISTINCT start_id, end_id, 3 FROM t3"""


@query(_walk_sql("'REFERENCES', 'PRECEDES'", "both", 3, "a LIKE 'order:%'") + " SELECT DISTINCT start_id, end_id, CAST(length AS INT) AS length FROM w")
def g6_procedural(spark, d):
    starts = table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"))
    return _ends(graph.procedural(starts, edges(spark, d), 3))


@query(_ends_sql("'PART_OF', 'DEPENDS_ON', 'REFERENCES', 'CONTAINS'", "a LIKE 'supplier:%'"))
def g7_multi_hop(spark, d):
    return _ends(graph.multi_hop(_starts(spark, d, "supplier"), edges(spark, d), 3))


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1")
def a16_text_statistics(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.size(F.split("text", "\n", -1))).cast("long").alias("lines"))


@query("SELECT event_type AS kind, count(*) AS n, round(count(*) / greatest((SELECT (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / 60 FROM events), 1.0 / 60), 6) AS per_minute FROM events GROUP BY 1")
def a20_session_statistics(spark, d):
    return commands.session_statistics(table(spark, d, "events").select("ts", F.col("event_type").alias("kind"))).select("kind", "n", r6("per_minute"))


@query(f"WITH {CAND} SELECT a.candidate_key AS a_key, b.candidate_key AS b_key, CASE WHEN a.confidence_score >= b.confidence_score THEN a.canonical_name ELSE b.canonical_name END AS primary_name, CAST(a.mention_count + b.mention_count AS BIGINT) AS mention_count, round(greatest(a.confidence_score, b.confidence_score), 6) AS confidence_score, 1 AS shared_aliases FROM cand a JOIN cand b ON a.user_id = b.user_id AND a.candidate_key < b.candidate_key")
def a24_comparison(spark, d):
    c = candidate_rows(spark, d)
    one = c.select("canonical_name", F.struct(*c.columns).alias("a"))
    both = one.join(c.select(F.col("canonical_name").alias("n2"), F.struct(*c.columns).alias("b")), F.col("canonical_name") == F.col("n2")).filter("a.candidate_key < b.candidate_key")
    return curate.compare(both).select("a_key", "b_key", "primary_name", "mention_count", r6("confidence_score"), "shared_aliases")


@query("SELECT p_brand AS raw_text, 'id' || (min(p_partkey) % 3) AS canonical_id, CAST(CASE WHEN p_brand LIKE '%1' THEN 2 ELSE 1 END AS INT) AS version FROM part GROUP BY p_brand")
def t33_normalization_upsert(spark, d):
    new = table(spark, d, "part").groupBy(F.col("p_brand").alias("raw_text")).agg(F.concat(F.lit("id"), (F.min("p_partkey") % 3).cast("string")).alias("canonical_id"))
    old = new.filter(F.col("raw_text").endswith("1")).select("raw_text", F.lit("old").alias("canonical_id"), F.lit(1).alias("version"))
    return curate.upsert_normalization(old, new).select("raw_text", "canonical_id", F.col("version").cast("int").alias("version"))


@query("SELECT doc_id, substr(text, greatest(strpos(text, '.') - 81, 0) + 1, least(strpos(text, '.') + 80, length(text)) - greatest(strpos(text, '.') - 81, 0)) AS context FROM documents WHERE contains(text, '.')")
def w14_snippet(spark, d):
    at = F.locate(".", F.col("text"))
    return table(spark, d, "documents").filter(F.col("text").contains(".")).select("doc_id", X.snippet(F.col("text"), at - 1, at).alias("context"))


@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'I don''t have enough information to say. ' WHEN conv_id % 5 = 1 THEN 'I cannot answer that. ' ELSE '' END || coalesce(text, '') AS t, CASE WHEN conv_id % 7 <> 0 THEN (turn % 10) / 10.0 END AS s FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, round(greatest(0, least(1, coalesce(s, 0) * CASE WHEN len(regexp_split_to_array(trim(t), '\\s+')) < 10 THEN 0.5 ELSE 1 END * CASE WHEN contains(lower(t), 'don''t have enough information') OR contains(lower(t), 'cannot answer') THEN 0.2 ELSE 1 END)), 6) AS confidence FROM a""".replace("\\\\", "\\"))
def t34_answer_confidence(spark, d):
    start = F.when(F.col("conv_id") % 5 == 0, "I don't have enough information to say. ").when(F.col("conv_id") % 5 == 1, "I cannot answer that. ").otherwise("")
    said = table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.concat(start, F.coalesce("text", F.lit(""))).alias("a"), F.when(F.col("conv_id") % 7 != 0, (F.col("turn") % 10) / 10.0).alias("s"))
    return said.select("conv_id", "turn", r6(scores.answer_confidence(F.col("a"), F.col("s")), "confidence"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def p1_iso_projection(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 20 = 0)")
def f3_point_lookup(spark, d):
    c = table(spark, d, "customer")
    wanted = c.filter("c_custkey % 20 = 0").select(F.upper("c_name").alias("name"))
    return c.join(wanted, F.lower("c_name") == F.lower("name"), "left_semi").select("c_custkey", "c_name")


@query(f"WITH {CAND} SELECT candidate_key FROM cand WHERE status IN ('pending', 'approved') ORDER BY confidence_score DESC, mention_count DESC, candidate_key LIMIT 2000")
def src10_candidate_scan(spark, d):
    return C.scan(candidate_rows(spark, d)).select("candidate_key")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT 'deleted' FROM documents WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0) GROUP BY 1")
def a23_change_counts(spark, d):
    from graphloom.queries import i1_change_detection

    return updates.report_counts(i1_change_detection(spark, d))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id + 1000000 FROM documents WHERE doc_id % 10 = 0")
def i2_apply_report(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    report = docs.filter("document_id % 5 = 0").withColumn("status", F.when(F.col("document_id") % 10 == 0, "modified").otherwise("deleted"))
    new = docs.filter("document_id % 10 = 0").select((F.col("document_id") + 1000000).alias("document_id"))
    return updates.apply_report(docs, docs, report, new, new)[0].select(F.col("document_id").alias("doc_id"))


@query("SELECT a.doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.doc_id)")
def j12_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE source IN ('src3', 'src4')")
def f13_chunks_mentioning(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("level"), F.col("doc_id").cast("string").alias("path"), F.array("source", "lang").alias("entity_ids"))
    return chunks.mentioning(c, ["src3", "src4"], None).select(F.col("chunk_id").alias("doc_id"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def x_event_windows(spark, d):
    return updates.event_windows(table(spark, d, "events")).select(F.col("window.start").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))
