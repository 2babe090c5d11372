"""Reading of questions: Column in, Column out (ids of the blueprint in brackets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intent patterns, relationship phrases, synonyms, constraint forms, words that ask for a graph.
INTENTS = {
    "semantic": (r"\bwhat is\b", r"\bwhat are\b", r"\bdefine\b", r"\bexplain\b", r"\bdescribe\b", r"\bhow does .* work\b", r"\bwhy\b", r"\bfunction of\b", r"\bpurpose of\b", r"\btell me about\b"),
    "structural": (r"\bcontain\b", r"\bpart of\b", r"\bcomponent[s]?\b", r"\bsubsystem[s]?\b", r"\bmade of\b", r"\bconsist[s]? of\b", r"\binclude[s]?\b", r"\bbelongs? to\b", r"\bhierarchy\b", r"\bstructure\b", r"\bcomposed of\b"),
    "procedural": (r"\bhow to\b", r"\bsteps?\b", r"\bprocedure[s]?\b", r"\bprocess\b", r"\binstructions?\b", r"\bperform\b", r"\bexecute\b", r"\bcarry out\b", r"\bsequence\b", r"\border of\b"),
}
PHRASES = (
    ("part of", "PART_OF"), ("contains", "CONTAINS"), ("contain", "CONTAINS"), ("contained", "CONTAINS"), ("depends on", "DEPENDS_ON"), ("depend on", "DEPENDS_ON"),
    ("dependent", "DEPENDS_ON"), ("dependency", "DEPENDS_ON"), ("dependencies", "DEPENDS_ON"), ("controls", "CONTROLS"), ("control", "CONTROLS"), ("monitors", "MONITORS"),
    ("monitor", "MONITORS"), ("power", "PROVIDES_POWER_TO"), ("sends data", "SENDS_DATA_TO"), ("data flow", "SENDS_DATA_TO"), ("references", "REFERENCES"), ("reference", "REFERENCES"),
    ("precedes", "PRECEDES"), ("precede", "PRECEDES"), ("before", "PRECEDES"), ("after", "PRECEDES"), ("affects", "AFFECTS"), ("affect", "AFFECTS"), ("implements", "IMPLEMENTS"),
    ("implement", "IMPLEMENTS"), ("similar", "SIMILAR_TO"), ("caused by", "CAUSED_BY"), ("mitigated by", "MITIGATED_BY"),
)
SYNONYMS = (("system", ("subsystem", "module", "unit")), ("component", ("part", "element", "unit")), ("procedure", ("process", "operation", "workflow")), ("power", ("electrical", "energy")), ("data", ("information", "telemetry")), ("command", ("instruction", "control")), ("failure", ("anomaly", "issue", "problem")))
CONSTRAINTS = (
    ("gt", "confidence_score", r"(?iU)\bgreater than (\d+(?:\.\d+)?)\b"), ("lt", "confidence_score", r"(?iU)\bless than (\d+(?:\.\d+)?)\b"), ("eq", "entity_type", r"(?iU)\bequals? (\w+)\b"),
    ("contains", "content", r"(?iU)\bin (?:the )?(\w+)\b"), ("source", "document_id", r"(?iU)\bfrom (?:the )?(\w+)\b"), ("page", "page_number", r"(?iU)\b(?:in|on) page (\d+)\b"), ("document", "document_id", r"(?iU)\b(?:in|from) document (\w+)\b"),
)
GRAPH_WORDS = ("connected", "related", "relationship", "path", "hierarchy", "structure", "dependency", "dependencies")
DEEP_WORDS = ("comprehensive", "detailed", "analyze", "analysis", "compare", "comparison", "relationship between", "impact of", "effect of", "trace", "history of")


def normalized(question: Column) -> Column:
    """[T23] Trimmed, single blanks, no closing question mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(question), r"\s+", " "), r"\?+$", ""))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _score(q: Column, kind: str) -> Column:
    return sum((F.lower(q).rlike(p).cast("int") for p in INTENTS[kind]), F.lit(0))


def intent(question: Column) -> Column:
    """[T23] Struct of intent and confidence."""
    q = normalized(question)
    hits = {k: _score(q, k) > 0 for k in INTENTS}
    kinds = sum((h.cast("int") for h in hits.values()), F.lit(0))
    token = F.split(F.lower(q), r"[^a-z']+")
    first, second = F.get(token, F.lit(0)), F.get(token, F.lit(1))
    name = F.when(kinds >= 2, F.lit("hybrid"))
    for k, h in hits.items():
        name = name.when(h, F.lit(k))
    name = name.when((first == "how") & (second == "to"), F.lit("procedural")).otherwise(F.lit("semantic"))
    sure = F.when(kinds >= 2, F.lit(0.8)).when(kinds == 1, F.lit(0.9)).when(first.isin("what", "who", "how"), F.lit(0.7)).otherwise(F.lit(0.5))
    return F.struct(name.alias("intent"), sure.alias("confidence"))


def relationship_types(question: Column) -> Column:
    """[T24] Distinct types of the phrases in the question, sorted."""
    return _once(F.lower(normalized(question)), lambda q: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(q, F.lit(p)), F.lit(t)) for p, t in PHRASES])))))


def constraints(question: Column) -> Column:
    """[F8] Array of (field, operator, value)."""
    q = normalized(question)
    found = [_constraint(q, o, f, p) for o, f, p in CONSTRAINTS]
    return F.concat(*found)


def _constraint(q: Column, operator: str, field: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(field).alias("field"), F.lit(operator).alias("operator"), v.alias("value")))


def needs_graph(kind: Column, types: Column, question: Column) -> Column:
    """[T27]"""
    q = F.lower(normalized(question))
    return kind.isin("structural", "hybrid") | (F.size(types) > 0) | F.exists(F.array(*map(F.lit, GRAPH_WORDS)), lambda w: F.contains(q, w))


def max_depth(question: Column, default: int = 3) -> Column:
    """[T27] "n hops", else 1 for direct, immediate or first, else the default."""
    q = normalized(question)
    named = F.nullif(F.regexp_extract(q, r"(?i)\b(\d+)\s*(?:levels?|hops?|degrees?)\b", 1), F.lit("")).cast("int")
    return F.coalesce(named, F.when(F.lower(q).rlike("direct|immediate|first"), F.lit(1)), F.lit(default))


def is_complex(kind: Column, types: Column, question: Column) -> Column:
    """[T27]"""
    q = F.lower(question)
    return kind.isin("hybrid", "procedural") | F.exists(F.array(*map(F.lit, DEEP_WORDS)), lambda w: F.contains(q, w)) | (F.size(types) > 1) | (F.size(F.split(F.trim(question), r"\s+")) > 15)


def is_valid(question: Column) -> Column:
    """Two words or more and a confidence of 0.3 or more."""
    return (F.size(F.split(F.trim(question), r"\s+")) >= 2) & (intent(question)["confidence"] >= 0.3)


def query_id(question: Column) -> Column:
    """[T28] First 12 digits of the MD5."""
    return F.substring(F.md5(question), 1, 12)


def expansions(question: Column) -> Column:
    """[T25] Array of (term, synonyms) for the terms in the question."""
    q = F.lower(normalized(question))
    return F.filter(F.array(*[F.when(q.rlike(rf"\b{t}\b"), F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, s)).alias("synonyms"))) for t, s in SYNONYMS]), lambda x: x.isNotNull())


# Function words that are no keywords.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can", "does", "do", "for", "from", "how", "in", "is", "it", "of", "on", "or", "than", "that", "the", "there", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with")


def keywords(question: Column) -> Column:
    """[T26] Lower-cased words of three letters or more that are no function words, in order (stands for noun lemmas)."""
    w = F.regexp_extract_all(F.lower(normalized(question)), F.lit(r"[a-z][a-z0-9-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(w, lambda x: ~x.isin(*STOP_WORDS)))


def mentions(question: Column) -> Column:
    """[T26] Capitalised names and acronyms after the first word (stands for named entities)."""
    rest = F.regexp_replace(normalized(question), r"^\s*\S+\s*", "")
    return F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[A-Z][A-Za-z0-9-]*(?: [A-Z][A-Za-z0-9-]*)*"), F.lit(0)))


def strategy(kind: Column, n_mentions: Column, graph_needed: Column, configured: str = "auto") -> Column:
    """[H1] First match wins."""
    modes = ("vector_only", "graph_only", "vector_first", "graph_first", "hybrid_parallel")
    if configured != "auto":
        return F.lit(configured if configured in modes else "hybrid_parallel")
    return F.when((kind == "semantic") & (n_mentions == 0), "vector_only").when((kind == "structural") & (n_mentions > 0), "graph_first").when(kind == "procedural", "graph_first").otherwise("hybrid_parallel")


def graph_strategy(types: Column, n_mentions: Column) -> Column:
    """[G10] By the question's own types."""
    return _once(types, lambda t: F.when(F.array_contains(t, "PRECEDES"), F.lit("sequential")).when(F.array_contains(t, "REFERENCES"), F.lit("procedural")).when(F.arrays_overlap(t, F.array(F.lit("CONTAINS"), F.lit("PART_OF"))), F.lit("hierarchical")).when(n_mentions >= 2, F.lit("shortest_path")).otherwise(F.lit("multi_hop")))
