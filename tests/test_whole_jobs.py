"""Registered queries against plain Python over whole tables: what their SQL leaves out, these would show."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from graphloom.functions.text import VERSION_PATTERNS, date_of, version_of
from graphloom.llm import minhash
from graphloom.operators import discover as D_
from graphloom.operators import graph
from graphloom.queries import QUERIES
from graphloom.queries_text import SENTENCES
from graphloom.session import table

D = "/root/testdata/sf0.001"


def test_bm25_asks_every_stated_part(spark):
    docs = {r.p_partkey: re.findall("[a-z0-9]+", r.p_name.lower()) for r in table(spark, D, "part").collect()}
    df = Counter(t for ts in docs.values() for t in set(ts))
    mean = sum(map(len, docs.values())) / len(docs)

    def score(q, i):
        tf = Counter(docs[i])
        return sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for t in set(docs[q]) & set(tf))

    want = set()
    for q in (k for k in docs if k % 20 == 0):
        found = sorted((-round(score(q, i), 9), i) for i in docs)[:10]
        want |= {(q, i) for s, i in found if s}
    assert {(r.query_id, r.id) for r in QUERIES["t32_bm25_search"](spark, D).collect()} == want


def test_walks_take_three_steps(spark):
    """Trails by hand over a graph with parallel edges; then the third step of both queries."""
    e = spark.createDataFrame([("1", "s", "p", "DEPENDS_ON"), ("2", "p", "o", "REFERENCES"), ("3", "o", "q", "REFERENCES"), ("4", "s", "n", "PART_OF"), ("5", "n", "s", "CONTAINS"), ("6", "o", "r", "PRECEDES")], "edge_id string, src string, dst string, type string")
    steps = [(i, a, b) for r in e.collect() for i, a, b in ((r.edge_id, r.src, r.dst), (r.edge_id, r.dst, r.src)) if r.type != "PRECEDES"]
    want, now = set(), [(n, n, ()) for n in "spqn"]
    for length in (1, 2, 3):
        now = [(s, b, (*used, i)) for s, end, used in now for i, a, b in steps if a == end and i not in used]
        want |= {(s, b, length) for s, b, _ in now}
    starts = spark.createDataFrame([(n,) for n in "spqn"], "node string")
    got = [tuple(r) for r in graph.multi_hop(starts, e).collect()]
    assert len(got) == len(want) and set(got) == want
    for name in ("g6_procedural", "g7_multi_hop"):
        assert {r.length for r in QUERIES[name](spark, D).select("length").distinct().collect()} == {1, 2, 3}


def test_fuzzy_top_k_is_that_of_the_whole_table(spark):
    rows = [(1, "A", "pump one"), (2, "B", "pump one"), (3, "B", "Pump One"), (4, "C", "pump two"), (5, "A", "valve"), (6, "C", "valves"), (7, "D", "pump one"), (8, "D", None), (9, "E", "pump ona")]
    names = spark.createDataFrame(rows, "candidate_key long, candidate_type string, canonical_name string")

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    for k in (1, 2, 3):
        for by_type in (False, True):
            want = {}
            for s, t, x in rows:
                scored = sorted((distance(x.lower(), y.lower()) / max(len(x), len(y)), o) for o, u, y in rows if x and y and o != s and (u == t or not by_type))
                for far, o in [p for p in scored if 1 - p[0] >= (0.62 if min(len(x), len(rows[p[1] - 1][2])) < 8 else 0.60)][:k]:
                    want[min(s, o), max(s, o)] = round(1 - far, 9)
            got = D_.fuzzy_top_k(names, F.col("candidate_type") if by_type else None, k, 0.60).collect()
            assert {(r.a, r.b): round(r.score, 9) for r in got} == want and len(got) == len(want)
    parts = {r.p_partkey: r.p_brand for r in table(spark, D, "part").collect()}
    assert any(parts[r.a] != parts[r.b] for r in QUERIES["j9_topk_fuzzy"](spark, D).collect())


def test_versions_and_dates_of_all_documents(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, D, "documents").collect()}
    got = {r.doc_id: r.version for r in QUERIES["src7_version_date"](spark, D).collect()}
    found = {i: [m[1] for p in VERSION_PATTERNS if (m := re.search(p, t))] for i, t in texts.items()}
    assert got == {i: v[0] if v else None for i, v in found.items()} and any(got.values())


def test_version_and_date_of_sentences(spark):
    """The literals that the query had before, and forms that its first version and date patterns don't know."""
    texts = (*SENTENCES, "Revision: B.2, 02/30/2021", "rev. 7 of 03/04/2021", "see v1.2.3, 2021-02-30 or 12/31/2020")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", version_of(F.col("text")), date_of(F.col("text")))
    got = {r[0]: (r[1], r[2]) for r in df.collect()}
    assert got == {i: (None, None) for i in range(7)} | {7: ("2.4", "2021-03-04"), 8: ("B.2", None), 9: ("7", "2021-03-04"), 10: ("1.2.3", "2020-12-31")}


def test_hybrid_merge_has_all_graph_hits(spark):
    label = {r.vec_id: r.label for r in table(spark, D, "embeddings").collect()}
    want = {(q, i) for q in label if q % 20 == 0 for i in label if i != q and label[i] == label[q]}
    assert {(r.query_id, r.point_id) for r in QUERIES["j2_hybrid_merge"](spark, D).filter("graph_score is not null").collect()} == want


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long), (3, other), (3, other), (4, "a b c"), (None, long), (None, long), (None, other), (None, ""), (None, None), (5, None), (5, None)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, long), (3, other), (4, "a b c"), (None, long), (None, other), (None, ""), (None, None), (5, None)])


def test_suggestions_are_found_once_although_they_are_sorted(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x / 1000

    fuzzy = spark.range(900).repartition(3).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), counted(F.col("id")).alias("confidence"))
    rows = D_.union_suggestions(fuzzy, spark.createDataFrame([(1, 2, 2.0)], "a long, b long, confidence double")).collect()
    assert seen.value == 900 and len(rows) == 901
    assert [r.confidence for r in rows] == sorted((r.confidence for r in rows), reverse=True)
