"""Every registered query over the smallest tables: against its SQL, or against a brute-force version where there is none."""

import collections
import hashlib
import html as entities
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex

from graphloom.llm import quality
from graphloom.llm.queries import ORACLE_SQL, QUERIES, vocabulary

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        p = f"{D}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


def canon(df):
    show = lambda x: "" if x is None or x is pd.NaT or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    assert canon(pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)) == canon(con.execute(ORACLE_SQL[name]).df())


def test_op1(spark, con):
    def reference(page):
        """These pages hold one article each; everything else lies outside it."""
        body = re.search(r"<article>(.*?)(?:</article>|$)", re.sub(r"<!--.*?-->", "", page, flags=re.S), re.S)[1]
        parts = re.split(r"</?(?:p|h\d|div|ul|li)\b[^>]*>", body)
        return "\n".join(filter(None, (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", x))).split()) for x in parts)))

    expect = {i: reference(h) for i, h in con.execute("select page_id, html from pages").fetchall()}
    got = {r.page_id: r for r in QUERIES["op1_html_text"](spark, D).collect()}
    assert {i: r.text for i, r in got.items()} == expect and all(r.n_chars == len(r.text) for r in got.values())


def test_op4(spark, texts):
    seen = collections.Counter()
    data = {i: (t or "").encode() for i, t in texts.items()}
    for t in data.values():
        seen.update(hashlib.blake2b(t[i : i + 200], digest_size=8).digest() for i in range(len(t) - 199))
    expect = {}
    for i, t in data.items():
        edge = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 199):
            if seen[hashlib.blake2b(t[k : k + 200], digest_size=8).digest()] > 1:
                edge[k] += 1
                edge[k + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        expect[i] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_suffix_dedup"](spark, D).collect()} == expect


def test_op7(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    at, expect = 0, []
    for i in sorted(texts):
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        expect.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op7_token_blocks"](spark, D).collect())) == expect


def test_op8(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    expect = {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op8_minhash_dedup"](spark, D).collect()} == expect


def passes(line):
    """The line rules of operator 6, spelled out."""
    ws = "\x20\x09\x0a\x0b\x0c\x0d"
    if not line.strip(ws):
        return True
    short = len(line) < quality.LONG_LINE and line.rstrip(ws)[-1] not in quality.CLOSERS
    menu = len(regex.findall(r"[ \t\n\f\r][|>»•·/][ \t\n\f\r]", line)) >= 2
    symbols = 5 * sum(c in "#*$%&|<>" for c in line) > sum(c in ws for c in line) + 1
    shouts = 2 * len(regex.findall(r"\p{Lu}", line)) > len(line)
    notice = len(line) < quality.NOTICE_CHARS and regex.search(quality.BOILERPLATE, line.lower())
    return not (short or menu or symbols or shouts or notice)


def test_pipeline_against_brute_force(spark, con):
    """Quality, near-duplicates and decontamination from SQL and sets; then the mix and the tokenizer on what they keep."""
    import corpus_pipeline

    rows = {r[0]: r[1] for r in con.execute("select doc_id, text from documents").fetchall()}
    kept = [r[0] for r in con.execute(f"select doc_id from ({ORACLE_SQL['op6_line_quality']}) where kept").fetchall()]
    rows = {i: "\n".join(x for x in (t or "").split("\n") if passes(x)) for i, t in rows.items()}
    con.execute("create or replace temp table cleaned as select d.* replace (c.t as text) from documents d join (select unnest(?) as doc_id, unnest(?) as t) c using (doc_id)", [list(rows), list(rows.values())])
    sets = {}
    for i in sorted(kept):
        w = rows[i].encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    kept = [i for i in sets if group[i] == i]
    leaks = {r[0] for r in con.execute(f"select doc_id from ({ORACLE_SQL['op2_decontaminate'].replace('FROM documents', 'FROM cleaned')}) where contaminated").fetchall()}
    kept = [i for i in kept if i not in leaks]
    con.execute("create or replace temp table kept as select * from cleaned where doc_id in (select unnest(?))", [kept])
    mix = con.execute(ORACLE_SQL["op10_curriculum_mix"].replace("FROM documents", "FROM kept")).df()
    times = {int(r.doc_id): int((r.taken + r["size"] / 2) // r["size"]) for _, r in mix.iterrows() if r["size"]}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    expect = collections.Counter()
    for i, n in times.items():
        ids = t.encode(rows[i], add_special_tokens=False).ids + [1]
        if n:
            expect[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += n
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, D).collect())
    assert got == expect
