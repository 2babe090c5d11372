"""The queries opN_<name> and their DuckDB SQL. Each callable takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, html, minhash, mixing, quality, secrets, substring, suffix, tokens, warc
from graphloom.session import ready_workers, table


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicate(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
    return done.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.deduplicate(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return secrets.digest(found).select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "kept_chars", "n_bad_lines", F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    mixed = mixing.in_training_order(mixing.mix(rows, size=F.col("size"), tie=F.col("tie")))
    place = lambda k: F.round(F.get("positions", F.lit(k)), 9)
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", place(0).alias("position"), place(1).alias("second"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = tokens.write_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return tokens.read_tokens(folder, manifest)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_html_text, op2_decontaminate, op3_substring_dedup, op4_suffix_dedup, op5_secret_scan, op6_line_quality, op7_token_blocks, op8_minhash_dedup, op9_warc_archives, op10_curriculum_mix)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _secrets_sql() -> str:
    """Spans of each rule from the lengths of its matches and of the gaps between them."""
    parts = []
    for at, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {at} AS place, '{r.kind}' AS kind, a, a + m AS b FROM (
  SELECT doc_id, m, p, sum(g) OVER w + sum(m) OVER w - m AS a FROM (
    SELECT doc_id, i, length(ms[i]) AS m, length(ps[i]) AS p, length(gs[i]) AS g FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {r.group}) AS ps, string_split_regex(t, '{pattern}') AS gs FROM d), unnest(range(1, len(ms) + 1)) AS u(i))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE p >= {r.least}""")
    n_base = sum(r.base for r in secrets.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY a, place) FILTER (place < {n_base}) AS base,
  string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY a, place) AS every FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
cov AS (SELECT doc_id, count(DISTINCT i + o.j) AS n FROM hit, unnest(range(0, k)) AS o(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM d, unnest(range(1, len(w) - 33)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + o.j AS k FROM rep, range(0, 35) AS o(j)),
word AS (SELECT doc_id, k, w[k] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(k)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op5_secret_scan": _secrets_sql(),
    "op6_line_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS o(k) GROUP BY doc_id),
ln AS (SELECT doc_id, i, ls[i] AS l, regexp_matches(ls[i], '[^\x20\x09-\x0D]') AS has FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS r(i)),
every AS (SELECT *, NOT has OR ((length(l) >= {quality.LONG_LINE} OR contains('{quality.CLOSERS.replace("'", "''")}', regexp_extract(l, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1)))
         AND len(regexp_extract_all(l, '\s[|>»•·/]\s')) < 2
         AND 5 * len(regexp_extract_all(l, '[#*$%&|<>]')) <= len(regexp_extract_all(l, '[\x20\x09-\x0D]')) + 1
         AND 2 * length(regexp_replace(l, '[^\p{{Lu}}]+', '', 'g')) <= length(l)
         AND NOT (length(l) < {quality.NOTICE_CHARS} AND regexp_matches(lower(l), '{quality.BOILERPLATE.replace("'", "''")}'))) AS good FROM ln),
cl AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) FILTER (good) AS clean, count(*) FILTER (NOT good) AS bad FROM every GROUP BY doc_id),
ok AS (SELECT * FROM every WHERE has),
agg AS (SELECT doc_id, sum(length(l)) AS line_chars, coalesce(sum(length(l)) FILTER (good), 0) AS kept_chars, count(*) - count(DISTINCT l) AS dup FROM ok GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed, coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars, bad, sha256(coalesce(clean, '')) AS clean_sha256
         FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN agg USING (doc_id) LEFT JOIN cl USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND kept_chars >= 0.5 * line_chars AS kept, CAST(line_chars AS BIGINT) AS line_chars, CAST(kept_chars AS BIGINT) AS kept_chars,
  CAST(bad AS BIGINT) AS n_bad_lines, clean_sha256 FROM base
""",
    "op9_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM r
""",
    "op10_curriculum_mix": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM s0),
s2 AS (SELECT *, CASE k WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CASE k WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope, 2.0::DOUBLE * source_size AS lim FROM s1),
s3 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM s2),
s4 AS (SELECT *, max(CASE WHEN (total - below) / remaining <= lim / weight THEN (total - below) / remaining END) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, slope, least(lim, level * weight) AS target, CAST(round(least(lim, level * weight)) AS BIGINT) AS goal FROM s4),
r AS (SELECT d.doc_id, d.size, s5.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY d.key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM r),
q AS (SELECT *, CAST(passes * size + CASE WHEN passes < 2 THEN least(greatest(goal - passes * source_size - before_it, 0), size) ELSE 0 END AS BIGINT) AS taken FROM p)
SELECT doc_id, size, source_size, target, taken,
  round(CASE WHEN taken > 0 THEN 2 * least(before_it / target, 1) / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * least(before_it / target, 1))) END, 9) AS position,
  round(CASE WHEN goal - source_size - before_it > 0 AND size > 0 THEN 2 * least((source_size + before_it) / target, 1) / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * least((source_size + before_it) / target, 1))) END, 9) AS second FROM q
""",
}
