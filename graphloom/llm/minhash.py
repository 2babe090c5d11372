"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures (operator 8).

A document's set is its distinct shingles of some consecutive words. Its signature has SYMBOLS symbols of 16 bits, the
lowest bits of as many minima. Two sets of similarity s differ in each symbol with probability 1 - s; the join finds all
pairs that differ in at most DISTANCE = 23 of 48 symbols. At s = 0.8 a pair differs in more with probability 3e-6.

Multi-index: signatures are split into 12 chunks of 4 symbols. By the pigeonhole principle a pair within 23 errors has a
chunk with at most one, so every chunk is looked up four times, with each of its symbols left out in turn. All pairs
within the distance meet in one of these 48 keys, without exception.

Then: documents with equal sets form a class, for which one stands. Within each key, representatives within the distance
are chained; components of these chains are candidate clusters. Inside each cluster all pairs are confirmed on their full
sets, and components of the confirmed links are the result. A large key or cluster is cut into blocks and every pair of
blocks is a unit of its own, so no group has to fit in one task; only chains, not pairs, are sent on.

Defined cases: null ids stand for themselves and link with nothing; documents without words have an empty set and link
with nothing; rows that share an id are one document, whose links are those of all its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import segments as S
from graphloom.operators.components import components
from graphloom.llm.substring import Words
from graphloom.session import write_shared

SYMBOLS, CHUNK, DISTANCE = 48, 4, 23  # 12 chunks with one error each: 12 * 2 > 23
BLOCK = 2000  # documents of a key or cluster that one unit compares with as many others
BLOCK_BYTES = 4_000_000  # of their shingles
UNIT_ROWS = 10_000  # rows of one task's units
UNIT_BYTES = 8_000_000
SLICE = 1_000_000  # shingles hashed at a time

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased."""
    w = Words([t.lower() for t in texts], words)
    every = w.hashes(0)
    counts = np.maximum(w.counts - words + 1, 0)
    ends = np.cumsum(counts)
    out = [np.unique(every[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    for n in range(1, words):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(w.counts == n)
        if len(short):
            whole = S.sequence_hashes(np.ascontiguousarray(w.leaves[:, 0]), n)
            for i in short.tolist():
                out[i] = whole[w.firsts[i] : w.firsts[i] + 1]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of SYMBOLS 16-bit symbols; empty sets get zeros."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        to, total = at, 0
        while to < len(full) and (to == at or total + len(sets[full[to]]) <= SLICE):
            total += len(sets[full[to]])
            to += 1
        some = full[at:to]
        joined = np.concatenate([sets[i] for i in some])
        firsts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(joined * _MULTIPLY[k] + _ADD[k], firsts)
            out[some, k] = (S.mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)
        at = to
    return out


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                sets = shingle_sets([t or b"" for t in texts[at : at + 500]], words)
                sigs = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 500), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary())],
                    names=["doc_id", "n_shingles", "class", "signature"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """48 keys of each signature: each chunk with each of its symbols left out."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sigs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, SYMBOLS // CHUNK, CHUNK).astype(np.uint64)
        keys = np.empty((n, SYMBOLS // CHUNK, CHUNK), np.uint64)
        for out in range(CHUNK):
            a, b, c = (x for x in range(CHUNK) if x != out)
            keys[:, :, out] = sigs[:, :, a] | sigs[:, :, b] << np.uint64(16) | sigs[:, :, c] << np.uint64(32)
        keys = S.mix64(keys ^ (np.arange(SYMBOLS, dtype=np.uint64).reshape(1, -1, CHUNK) << np.uint64(50)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), SYMBOLS))], names=["key", "node"])


def _units(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Adds unit (a hash) and half (0 or 1): the members of a group meet in one unit, or in one for each pair of blocks.

    counts has the number of blocks of each group in _n.
    """
    met = rows.join(counts, key)
    blocks = F.col("_n").cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    # a single member of a block pair would miss none: each block meets itself in the pair (b, b)
    other = F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))).alias("_o")
    return (
        met.withColumn("_b", F.when(blocks == 1, F.lit(0)).otherwise(mine))
        .select("*", other)
        .withColumn("unit", F.xxhash64(F.col(key), F.least("_b", "_o"), F.greatest("_b", "_o")))
        .withColumn("half", (F.col("_b") > F.col("_o")).cast("int"))
        .drop("_n", "_b", "_o")
    )


def _stars(linked: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for an adjacency matrix."""
    m = len(nodes)
    label = np.arange(m)
    while True:
        low = np.where(linked, label[None, :], m).min(axis=1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(nodes[i]), int(nodes[j])) for i, j in enumerate(label.tolist()) if i != j]


def _chain(t: pa.Table) -> pa.Table:
    """Within each unit, chains of the nodes whose signatures are within the distance."""
    units = t.column("unit").to_numpy()
    order = np.argsort(units, kind="stable")
    nodes = t.column("node").to_numpy()[order]
    sigs = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)[order]
    units = units[order]
    heads = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
    sizes = np.diff(np.append(heads, len(units)))
    out: set[tuple[int, int]] = set()
    two = heads[sizes == 2]
    near = (sigs[two] != sigs[two + 1]).sum(axis=1) <= DISTANCE
    out.update(zip(nodes[two[near]].tolist(), nodes[two[near] + 1].tolist(), strict=True))
    done: set[bytes] = set()
    for h, m in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        name = np.sort(nodes[h : h + m]).tobytes()
        if name in done:
            continue
        done.add(name)
        # equal signatures first: one of each stands for the rest
        part, first, inverse = np.unique(sigs[h : h + m], axis=0, return_index=True, return_inverse=True)
        own = nodes[h : h + m]
        stand = own[first]
        out.update((int(a), int(b)) for a, b in zip(own, stand[inverse.reshape(-1)], strict=True) if a != b)
        linked = np.empty((len(part), len(part)), bool)
        for at in range(0, len(part), 64):
            linked[at : at + 64] = (part[at : at + 64, None, :] != part[None, :, :]).sum(axis=2, dtype=np.uint8) <= DISTANCE
        out.update(_stars(linked, stand))
    return _edge_table(out)


def _edge_table(pairs) -> pa.Table:
    pairs = list(pairs)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _confirm(percent: int):
    """Within each unit, chains of the nodes whose full sets are similar enough; in a pair of blocks only across."""

    def unit(nodes: list[int], sets: list[np.ndarray], halves: np.ndarray) -> list[tuple[int, int]]:
        m = len(nodes)
        sizes = np.array([len(s) for s in sets])
        across = bool(halves.any()) and not halves.all()
        parent = list(range(m))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if m == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return [(nodes[0], nodes[1])] if 100 * both >= percent * (sizes.sum() - both) else []
        values, local = np.unique(np.concatenate(sets), return_inverse=True)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        by = np.argsort(local, kind="stable")
        owner = np.repeat(np.arange(m), sizes)[by]
        begin = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(values)))])
        out = []
        left = m
        for i in range(m):
            mine = local[firsts[i] : firsts[i + 1]]
            counts = begin[mine + 1] - begin[mine]
            at = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
            common = np.bincount(owner[at], minlength=m)
            ok = 100 * common >= percent * (sizes + sizes[i] - common)
            ok[: i + 1] = False
            if across:
                ok &= halves != halves[i]
            for j in np.flatnonzero(ok).tolist():
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((nodes[i], nodes[j]))
                    left -= 1
            if left == 1:
                break
        return out

    def run(t: pa.Table) -> pa.Table:
        units = t.column("unit").to_numpy()
        order = np.argsort(units, kind="stable")
        units = units[order]
        nodes = t.column("node").to_numpy()[order].tolist()
        halves = t.column("half").to_numpy()[order]
        raw = t.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order.tolist()]
        cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
        out: set[tuple[int, int]] = set()
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                out.update(unit(nodes[a:b], sets[a:b], halves[a:b]))
        return _edge_table(out)

    return run


def _load_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for at in range(0, len(texts), 500):
                sets = shingle_sets([t or b"" for t in texts[at : at + 500]], words)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, 500), batch.column("cluster").slice(at, 500), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "cluster", "shingles"])

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept, for each row of docs."""
    if percent < 80:
        raise ValueError("the signature distance is set for a similarity of 0.8 or more")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("_text"))
    sketch = write_shared(rows.mapInArrow(_sketch(words), "doc_id long, n_shingles long, class binary, signature binary"), "sketch")
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = write_shared(known.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "classes")
    keys = classes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    units = _units(keys, "key", often.withColumn("_n", F.ceil(F.col("_n") / BLOCK))).select("unit", "node").join(classes.select("node", "signature"), "node")
    chains = write_shared(_in_tasks(write_shared(units, "units"), F.lit(1), UNIT_ROWS).applyInArrow(_chain, "a long, b long").distinct(), "chains")
    clusters = write_shared(components(chains).select("node", F.col("component").alias("cluster")), "clusters")
    members = rows.join(clusters, rows.doc_id == clusters.node).select("node", "cluster", "_text")
    weights = known.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("_w")).join(clusters, "node")
    sizes = weights.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, 8 * F.sum("_w") / BLOCK_BYTES)).alias("_n"))
    sets = _units(members.mapInArrow(_load_sets(words), "node long, cluster long, shingles binary"), "cluster", sizes)
    sets = write_shared(sets.select("unit", "half", "node", "shingles"), "sets")
    links = write_shared(_in_tasks(sets, F.octet_length("shingles"), UNIT_BYTES).applyInArrow(_confirm(percent), "a long, b long").distinct(), "links")
    found = components(links)
    placed = known.select("doc_id", "n_shingles", "class").join(classes.select("class", "node"), "class").join(found, "node", "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    rest = sketch.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _in_tasks(units: DataFrame, weight, most: int):
    """Groups whole units into about total / most groups, each of which is one call of a worker."""
    total = int(units.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0])
    groups = max(1, -(-total // most))
    return units.withColumn("_g", F.pmod(F.col("unit"), F.lit(groups))).groupBy("_g")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near-duplicates of a document with a smaller id, one row of each id.

    Null ids can't be linked: of those that hold the same shingles one row stays, and each row without a shingle. Only
    rows with a repeated or null id are shuffled with their texts.
    """
    key = F.col(f"`{doc_id}`").cast("long")
    gone = near_duplicates(docs, doc_id, text, words, percent).filter("not kept").select("doc_id").distinct()
    ids = docs.select(key.alias("doc_id")).filter("doc_id is not null")
    again = write_shared(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").join(gone, "doc_id", "left_anti").select(F.col("doc_id").alias("_again")), "again")
    gone = gone.select(F.col("doc_id").alias("_gone"))
    once = docs.filter(key.isNotNull()).join(gone.unionByName(again.withColumnRenamed("_again", "_gone")), key == F.col("_gone"), "left_anti")
    order = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.join(again, key == F.col("_again")).withColumn("_r", F.row_number().over(W.partitionBy("_again").orderBy(F.desc(F.length(order)), order)))
    return once.unionByName(rows.filter("_r = 1").select(*[F.col(f"`{c}`") for c in docs.columns])).unionByName(_one_a_class(docs.filter(key.isNull()), text, words))


def _one_a_class(docs: DataFrame, text: str, words: int) -> DataFrame:
    """docs with one row of each set of shingles, and all rows that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = shingle_sets([(t or "").encode() for t in some.column(text).to_pylist()], words)
                classes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(classes, pa.binary())], names=[*some.schema.names, "_class"])

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_class", T.BinaryType())]))
    first = rows.filter("_class is not null").withColumn("_r", F.row_number().over(W.partitionBy("_class").orderBy(F.desc(F.length(f"`{text}`")), f"`{text}`"))).filter("_r = 1").drop("_r")
    return first.unionByName(rows.filter("_class is null")).drop("_class")
