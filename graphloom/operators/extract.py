"""Extraction from text (ids of the blueprint in brackets): relationships, mentions, acronyms, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scores
from graphloom.functions.text import acronym_definitions, sentences, snippet

# Connecting words of rule-based relationships; the flag tells whether the source stands first.
CONNECTIVES = (
    ("IS_A", " is a type of ", True), ("IS_A", " is a kind of ", True), ("IS_A", " such as ", False), ("IS_A", ",? including ", False),
    ("PART_OF", " consists of ", False), ("PART_OF", " comprises ", False), ("PART_OF", " is composed of ", False), ("PART_OF", " is a part of ", True), ("PART_OF", " is a component of ", True),
    ("CONTAINS", " contains ", True), ("CONTAINS", " includes ", True), ("CONTROLS", " controls ", True), ("CONTROLS", " regulates ", True), ("CONTROLS", " manages ", True),
    ("MONITORS", " monitors ", True), ("MONITORS", " tracks ", True), ("MONITORS", " measures ", True), ("PROVIDES_POWER_TO", " powers ", True), ("PROVIDES_POWER_TO", " supplies power to ", True), ("PROVIDES_POWER_TO", " energizes ", True),
)
# Verbs of subject-verb-object relationships.
VERBS = {"control": "CONTROLS", "regulate": "CONTROLS", "manage": "CONTROLS", "monitor": "MONITORS", "measure": "MONITORS", "track": "MONITORS", "power": "PROVIDES_POWER_TO", "supply": "PROVIDES_POWER_TO", "contain": "CONTAINS", "include": "CONTAINS", "require": "REQUIRES", "trigger": "TRIGGERS", "cause": "CAUSES", "support": "SUPPORTS"}
_SPAN = "([A-Za-z0-9 _-]+)"
_START = "(?<![A-Za-z0-9 _-])"
_ENDS = "array<struct<source:string,target:string,type:string>>"


def relationships(texts: DataFrame, text: str = "text", longest: int = 50) -> DataFrame:
    """[T17] Adds a row for each match: source, target, type, confidence 0.8; no self loops, no long names.

    A match can only begin where a run of name characters does, so the patterns look from there alone and their time is
    linear in the text.
    """
    found = []
    for kind, words, forward in CONNECTIVES:
        pattern = F.lit(f"(?i){_START}{_SPAN}{words}{_SPAN}")
        ends = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("x"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("y"))
        a, b = ("x", "y") if forward else ("y", "x")
        there = F.contains(F.lower(text), F.lit(words.removeprefix(",?")))
        found.append(F.when(there, _ends(ends, kind, a, b)).otherwise(F.array().cast(_ENDS)))
    # The outer explosion keeps Spark from computing the array a second time to filter empty ones; nulls go by `ok`.
    rows = texts.select("*", F.explode_outer(F.concat(*found)).alias("_r")).select("*", "_r.source", "_r.target", "_r.type", F.lit(0.8).alias("confidence"), F.lit("pattern").alias("source_extractor")).drop("_r")
    ok = (F.length("source") <= longest) & (F.length("target") <= longest) & (F.col("source") != "") & (F.col("target") != "") & (F.lower("source") != F.lower("target"))
    return rows.filter(ok).distinct()


def _ends(ends: Column, kind: str, a: str, b: str) -> Column:
    return F.transform(ends, lambda e: F.struct(F.trim(e[a]).alias("source"), F.trim(e[b]).alias("target"), F.lit(kind).alias("type")))


def verb_relationships(texts: DataFrame, text: str = "text") -> DataFrame:
    """[T18] An approximation of dependency parsing: capitalised or article-led phrase, verb of the lexicon, phrase; confidence 0.7."""
    each = texts.select("*", F.explode(sentences(F.col(text))).alias("_s"))
    noun = r"((?:(?:[Tt]he|[Aa]n?) )?[A-Za-z][A-Za-z0-9-]*(?: [A-Za-z][A-Za-z0-9-]*){0,3}?)"
    parts = []
    for verb, kind in VERBS.items():
        stem = verb[:-1] + "ies" if verb.endswith("y") else verb + "s"
        pattern = rf"\b{noun} {stem} {noun}(?=[.,;!?]|$| (?:and|with|for|in|on|by|to)\b)"
        parts.append(F.when(F.col("_s").rlike(pattern), F.struct(F.regexp_extract("_s", pattern, 1).alias("source"), F.regexp_extract("_s", pattern, 2).alias("target"), F.lit(kind).alias("type"))))
    rows = each.select("*", F.explode(F.array_compact(F.array(*parts))).alias("_r"))
    strip = lambda c: F.regexp_replace(c, r"(?i)^(?:the|an?) ", "")
    return rows.select("*", strip(F.col("_r.source")).alias("source"), strip(F.col("_r.target")).alias("target"), F.col("_r.type").alias("type"), F.lit(0.7).alias("confidence")).drop("_r", "_s")


def gazetteer(texts: DataFrame, terms: DataFrame, key: str = "chunk_id", text: str = "text", longest: int = 5, cutoff: float = 0.5) -> DataFrame:
    """[T19, T20, W14] Mentions of terms (term, type, source): n-grams of words meet the terms in one equi-join.

    Overlaps go to the longest span, then the first. The lookup side is as large as the vocabulary; Spark chooses how to
    join by its size.
    """
    pattern = r"[\w+#/.-]*[\w+#]"
    words = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))
    gaps = F.split(F.col(text), f"(?U){pattern}", -1)
    places = F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("m"))), F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("o")), lambda a, x: F.struct((a["p"] + x["g"] + x["m"]).alias("p"), F.array_append(a["o"], a["p"] + x["g"]).alias("o")), lambda a: a["o"])
    base = texts.select(key, F.col(text).alias("_t"), words.alias("_w"), places.alias("_p"))
    grams = base.select(key, "_t", "_w", "_p", F.posexplode("_w").alias("_i", "_first")).select(key, "_t", "_w", "_p", "_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - F.col("_i")))).alias("_n"))
    spans = grams.select(key, "_t", "_n", F.get("_p", F.col("_i")).alias("start_char"), (F.get("_p", F.col("_i") + F.col("_n") - 1) + F.length(F.get("_w", F.col("_i") + F.col("_n") - 1))).alias("end_char"))
    spans = spans.withColumn("name", F.substr("_t", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
    met = spans.join(terms.select(F.lower("term").alias("_k"), "type", "source"), F.lower("name") == F.col("_k"))
    scored = met.withColumn("context", snippet(F.col("_t"), F.col("start_char"), F.col("end_char"))).withColumn("confidence", scores.mention_score(F.col("name"), F.col("type"), F.col("source"), F.col("context"))).filter(F.col("confidence") >= cutoff)
    order = W.partitionBy(key).orderBy("start_char", F.desc(F.col("end_char") - F.col("start_char")), "type")
    reach = F.max("end_char").over(order.rowsBetween(W.unboundedPreceding, -1))
    return scored.withColumn("_e", reach).filter("_e is null or start_char >= _e").select(key, "name", "type", "source", "start_char", "end_char", "context", "confidence")


def acronym_dictionary(texts: DataFrame, text: str = "text", contexts: int = 10) -> DataFrame:
    """[T14, A19] acronym, expansion, n, share, contexts (at most ten sentences, the first in order)."""
    each = texts.select(F.explode(sentences(F.col(text))).alias("s")).select("s", F.explode(acronym_definitions(F.col("s"))).alias("d"))
    rows = each.select("d.acronym", "d.expansion", "s").groupBy("acronym", "expansion").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("s")), 1, contexts).alias("contexts"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("acronym")))


def resolve_acronyms(asked: DataFrame, dictionary: DataFrame, overrides: DataFrame | None = None, similarity=None) -> DataFrame:
    """[T15] asked: acronym, context. Adds expansion and confidence: an override, the only one, or 0.6 context + 0.4 share."""
    similar = similarity or (lambda a, b: F.when(F.size(F.split(a, " ")) > 0, F.size(F.array_intersect(F.split(F.lower(a), " "), F.split(F.lower(b), " "))) / F.size(F.array_distinct(F.split(F.lower(a), " ")))))
    met = asked.join(dictionary, "acronym", "left").withColumn("_known", F.count("expansion").over(W.partitionBy("acronym", "context")))
    context = F.coalesce(F.array_max(F.transform("contexts", lambda c: similar(F.col("context"), c))), F.lit(0.0))
    met = met.withColumn("_c", F.when(F.col("_known") == 1, F.lit(1.0)).when(F.col("expansion").isNotNull(), scores.clamp(0.6 * context + 0.4 * F.col("share"), 0.2, 1.0)))
    best = met.groupBy("acronym", "context").agg(F.max_by("expansion", F.struct("_c", "n", "expansion")).alias("expansion"), F.max("_c").alias("confidence"))
    if overrides is None:
        return best
    o = overrides.select("acronym", F.col("expansion").alias("_o"))
    return best.join(o, "acronym", "left").select("acronym", "context", F.coalesce("_o", "expansion").alias("expansion"), F.when(F.col("_o").isNotNull(), F.greatest(F.lit(0.95), F.coalesce("confidence", F.lit(0.0)))).otherwise(F.col("confidence")).alias("confidence"))


def enrich_aliases(rows: DataFrame, dictionary: DataFrame, key: str = "name") -> DataFrame:
    """[T16] Names that hold a known acronym get its best expansion, alone and in place, as aliases."""
    best = dictionary.groupBy("acronym").agg(F.max_by("expansion", F.struct("n", "expansion")).alias("_x"))
    each = rows.select(key, F.explode(F.regexp_extract_all(key, F.lit(r"\b[A-Z]{2,8}\b"), F.lit(0))).alias("acronym")).distinct().join(best, "acronym")
    more = each.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("_x"), F.replace(F.col(key), F.col("acronym"), F.col("_x"))))))).alias("_more"))
    return rows.join(more, key, "left").withColumn("aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


ANSWER = "entities array<struct<name:string,text:string,type:string,entity_type:string,confidence:double,aliases:array<string>,description:string>>, relationships array<struct<source:string,target:string,type:string,relationship_type:string,confidence:double,description:string>>"


def parse_answers(answers: DataFrame, raw: str = "answer") -> tuple[DataFrame, DataFrame]:
    """[T21] (entities, relationships) from model answers that hold JSON; key fall-backs, confidences clamped (0.5 where missing)."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = answers.withColumn("_j", F.from_json(body, ANSWER, {"mode": "PERMISSIVE"}))
    base = [c for c in answers.columns if c != raw]
    e = got.select(*base, F.explode("_j.entities").alias("e")).select(*base, F.coalesce("e.name", "e.text").alias("name"), F.upper(F.coalesce("e.type", "e.entity_type")).alias("type"), scores.clamp(F.coalesce("e.confidence", F.lit(0.5))).alias("confidence"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), "e.description")
    r = got.select(*base, F.explode("_j.relationships").alias("r")).select(*base, "r.source", "r.target", F.upper(F.coalesce("r.type", "r.relationship_type")).alias("type"), scores.clamp(F.coalesce("r.confidence", F.lit(0.5))).alias("confidence"), "r.description")
    return e.filter("trim(name) <> ''"), r.filter("trim(source) <> '' and trim(target) <> ''")


def answer_context(hits: DataFrame, most: int = 5, longest: int = 1500) -> DataFrame:
    """[T34] query_id, context (the best chunks, numbered and cut), citations and mean score over all chunks."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = hits.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.avg("score").over(W.partitionBy("query_id")))
    top = rows.filter(F.col("_r") <= most).withColumn("_line", F.concat(F.lit("["), F.col("_r").cast("string"), F.lit("] "), F.substring("content", 1, longest)))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_line"))), lambda x: x["_line"]), "\n\n").alias("context"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "chunk_id"))), lambda x: x["chunk_id"]).alias("citations"), F.first("_m").alias("mean_score"))


def union_relationships(models: DataFrame, rules: DataFrame) -> DataFrame:
    """[U2] What models and what patterns found, one under the other; source_extractor tells which. Columns of either, missing ones null."""
    named = lambda df, kind: df if "source_extractor" in df.columns else df.withColumn("source_extractor", F.lit(kind))
    return named(models, "llm").unionByName(named(rules, "pattern"), allowMissingColumns=True)


def union_known(*sides: DataFrame) -> DataFrame:
    """[U2] chunk_id, name: the entities that any side knows in a chunk, each once by its lower-cased name."""
    out = sides[0].select("chunk_id", "name")
    for s in sides[1:]:
        out = out.unionByName(s.select("chunk_id", "name"))
    return out.groupBy("chunk_id", F.lower(F.trim("name")).alias("_n")).agg(F.min("name").alias("name")).drop("_n")
