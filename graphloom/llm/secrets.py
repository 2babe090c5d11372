"""Secret scans through a trigram inverted index (operator 5), in DataFrame functions only.

Each rule's pattern is turned into a Boolean query over trigrams that any match must contain. The trigrams of all queries
are indexed: for each block of documents, a sorted posting list a trigram. Queries are answered by intersecting and
uniting the postings of a block, and the candidates are verified by their pattern; a rule without mandatory trigrams
scans every text. Positions come from the lengths of matches and of the gaps between them.

Defined cases: a null text is empty and holds nothing; rows with a null id are candidates of every rule; rows that share
an id are verified one by one; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import trigrams as Q

BLOCK_DOCS = 4096


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1
    base: bool = False


# The base kinds in their order, then public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def build_index(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns block, trigram, postings (sorted ids) for the trigrams that the rules' queries use."""
    wanted = sorted(set().union(*(Q.trigrams_of(Q.query(r.pattern)) for r in rules)))
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    folded = docs.select(F.col(f"`{doc_id}`").alias("id"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t")).filter("id is not null")
    held = folded.select("id", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(F.col("t"), g))).alias("trigram"))
    return held.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "trigram").agg(F.array_sort(F.collect_set("id")).alias("postings"))


def _answer(q, lists: Column, kind: str) -> Column:
    if isinstance(q, str):
        return F.coalesce(F.element_at(lists, q), F.array().cast(kind))
    parts = [_answer(x, lists, kind) for x in q[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if q[0] == "and" else F.array_union(out, p)
    return out


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """Columns id, rules (kinds whose trigram query the document satisfies), for the rules that have one."""
    kind = index.schema["postings"].dataType.simpleString()
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    queries = [(r.kind, Q.query(r.pattern)) for r in rules]
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), _answer(q, F.col("lists"), kind).alias("ids")) for k, q in queries if q != Q.ALL])
    each = lists.select(F.explode(hits).alias("hit")).select("hit.kind", F.explode("hit.ids").alias("id"))
    return each.groupBy("id").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, at: int) -> Column:
    """Array of (start, kind's place, end, kind) of the rule's matches in order, code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), part, lambda x, p: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.length(p).alias("p")))
    kind = "array<struct<start:int,place:int,end:int,kind:string>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["pos"] + x["g"], acc["pos"] + x["g"] + x["m"]
        span = F.array(F.struct(a.alias("start"), F.lit(at).alias("place"), b.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(b.alias("pos"), F.when(x["p"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns row (docs' columns, or those in keep) and spans, an array of (start, place, end, kind) in order."""
    found = candidates(build_index(docs, rules, doc_id, text), rules)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    met = rows.join(found.hint("shuffle_hash"), rows["_id"] == found["id"], "left")
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        if Q.query(r.pattern) == Q.ALL:
            look = F.col("_t").rlike(r.pattern)
        else:
            look = F.col("_id").isNull() | F.coalesce(F.array_contains("rules", r.kind), F.lit(False))
        parts.append(F.when(look, _spans(F.col("_t"), r, i)).otherwise(none))
    return met.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, rules=RULES) -> DataFrame:
    """row, n_<kind> of the base kinds, base_sha256 and spans as text."""
    n_base = sum(r.base for r in rules)
    base = F.filter("spans", lambda s: s["place"] < n_base)
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return scanned.select("row", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
