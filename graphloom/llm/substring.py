"""Substring deduplication behind a count-min prefilter (operator 3).

A window is `window` consecutive words of one document. First pass: each segment's windows make a partition sketch of
two rows, sent as its non-empty cells; the sketches of a range of cells are merged, which can only overestimate a
window's count, and every segment hears which of its cells reach two. Second pass: windows whose cells reach two in both
rows are estimated repeated, and only those are grouped exactly, by 128 bits made of the words' 128-bit digests. No window that repeats is lost,
as merged counters are never below the true count. Words that a repeated window covers are removed.

The sketch's width follows the number of windows, so its error does not grow with the input.

Defined cases: a null text has no words; a document of fewer than `window` words has no window and loses nothing; rows
that repeat lose all their windows, as each starts somewhere else too; a text longer than a segment is one of its own and
is processed whole; docs' columns travel in a struct, so their names clash with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import segments as S
from graphloom.session import write_shared

WINDOW = 35
ROWS = 2  # of the sketch
LOAD = 4  # cells for each window in each row
SKETCH_BITS = 22  # cells of a shard of the sketch


class Words:
    """The words of a segment's texts, one after another. A word's two leaves are the halves of its 128-bit digest."""

    def __init__(self, texts: list[bytes], window: int):
        trimmed = pc.ascii_trim_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        words = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))
        self.counts = pc.fill_null(words.value_lengths(), 0).to_numpy().astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
        self.leaves = digests[coded.indices.to_numpy()]
        n = len(self.leaves)
        self.at = np.flatnonzero(np.arange(n) + window <= np.repeat(self.firsts[1:], self.counts))  # words at which a window starts
        self.window = window

    def hashes(self, seed: int) -> np.ndarray:
        """Of the windows that start at self.at; both seeds together are 128 bits."""
        return S.sequence_hashes(np.ascontiguousarray(self.leaves[:, seed]), self.window)[self.at]


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return S.mix64(hashes ^ np.uint64(0xA0761D6478BD642F * (row + 1) & S.MASK)) >> np.uint64(64 - bits)


def _sketch(window: int, bits: int):
    shard_bits = max(0, bits - SKETCH_BITS)

    def run(batches):
        for batch in batches:
            for seg, data in zip(batch.column("seg").to_pylist(), batch.column("data").to_pylist(), strict=True):
                hashes = Words(S.unpack(data)[1], window).hashes(0)
                rows = [(row, shard, seg, n, block) for row in range(ROWS) for shard, n, block in S.key_blocks(_cells(hashes, row, bits), bits, shard_bits)]
                if rows:
                    yield _block_batch(rows)

    return run


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "shard", "seg", "n", "data"])


def _estimated(hashes: np.ndarray, bits: int, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
    """Windows whose count is estimated at two or more."""
    shard_bits = max(0, bits - SKETCH_BITS)
    out = np.ones(len(hashes), bool)
    for row in range(ROWS):  # answers name cells by their place among all cells of the segment, so all are needed
        out &= S.apply_answers(_cells(hashes, row, bits), bits, shard_bits, answers.get(row, {}))
    return out


EXACT_KIND = 9


def _exact_blocks(a: np.ndarray, b: np.ndarray, shard_bits: int):
    """(shard, entries, data): distinct pairs (a, b) of this segment, sorted, with a mark for repeats here."""
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    many = np.diff(np.append(at, len(a))) > 1
    a, b = a[at], b[at]
    shards = (a >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(a), np.int64)
    cuts = np.flatnonzero(np.diff(shards)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(a)], strict=True):
        deltas = a[lo:hi].copy()
        deltas[1:] -= a[lo : hi - 1]
        yield int(shards[lo]), hi - lo, S._join(S.planes(deltas), S._join(b[lo:hi].tobytes(), S.squeeze(np.packbits(many[lo:hi]).tobytes())))


def _merge_pairs(t: pa.Table) -> pa.Table:
    """As segments.merge_exact, for pairs of 64-bit keys."""
    parts = []
    for n, data in zip(t.column("n").to_pylist(), t.column("data").to_pylist(), strict=True):
        k = int.from_bytes(data[:4], "little")
        rest = data[4 + k :]
        m = int.from_bytes(rest[:4], "little")
        parts.append((np.cumsum(S.from_planes(data[4 : 4 + k], np.dtype(np.uint64)), dtype=np.uint64), np.frombuffer(rest, np.uint64, n, 4), np.unpackbits(np.frombuffer(S.release(rest[4 + m :]), np.uint8))[:n]))
    a, b, many = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    total = np.add.reduceat(many[order].astype(np.int64) + 1, heads)
    twice = np.empty(len(a), bool)
    twice[order] = np.repeat(total >= 2, np.diff(np.append(heads, len(a))))
    return S._answers(t, np.split(twice, np.cumsum([len(p[0]) for p in parts])[:-1]))


def _covered(places: np.ndarray, length: int, total: int) -> np.ndarray:
    """True for each of total places that a run of `length` from one of the given places covers."""
    edge = np.zeros(total + 1, np.int32)
    edge[places] += 1
    np.subtract.at(edge, np.minimum(places + length, total), 1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Columns row (docs' columns, or those in keep), n_words, n_removed, kept_sha256 and kept_text (kept words joined by one space)."""
    keep = keep or docs.columns
    segs = S.pack(docs, keep, text)
    size = int(segs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    windows = max(1, size // 6)  # a word and its space take six bytes or so
    bits = min(48, max(16, (LOAD * windows - 1).bit_length()))
    sketches = segs.select("seg", "data").mapInArrow(_sketch(window, bits), S.BLOCK_SCHEMA)
    answers = write_shared(sketches.groupBy("kind", "shard").applyInArrow(S.merge_sketch(min(bits, SKETCH_BITS)), S.ANSWER_SCHEMA), "estimated")
    shard_bits = S.shard_bits_for(windows)

    def estimate(seg: int, data: bytes, found: dict) -> pa.Table:
        words = Words(S.unpack(data)[1], window)
        a = words.hashes(0)
        mask = _estimated(a, bits, found)
        words.at = words.at[mask]
        rows = [(EXACT_KIND, shard, seg, n, block) for shard, n, block in _exact_blocks(a[mask], words.hashes(1), shard_bits)]
        return pa.Table.from_batches([_block_batch(rows)]) if rows else _EMPTY_BLOCKS

    block_schema = T._parse_datatype_string(S.BLOCK_SCHEMA)
    blocks = S.by_segment(segs, answers, estimate, block_schema)
    exact = blocks.groupBy("kind", "shard").applyInArrow(_merge_pairs, S.ANSWER_SCHEMA)
    row_type = T.StructField("row", docs.select(*[f"`{c}`" for c in keep]).schema)
    out_schema = T.StructType([row_type, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())] + ([T.StructField("kept_text", T.StringType())] if with_text else []))

    def remove(_: int, data: bytes, found: dict) -> pa.Table:
        rows, texts = S.unpack(data)
        words = Words(texts, window)
        a = words.hashes(0)
        mask = _estimated(a, bits, found)
        words.at, a = words.at[mask], a[mask]
        gone = _covered(words.at[_marked_pairs(a, words.hashes(1), shard_bits, found.get(EXACT_KIND, {}))], window, len(words.leaves))
        removed, digests, kept_texts = [], [], []
        for i, t in enumerate(texts):
            lost = gone[words.firsts[i] : words.firsts[i + 1]]
            kept = t.split()
            if n := int(lost.sum()):
                kept = [w for w, x in zip(kept, lost.tolist(), strict=True) if not x]
            kept = b" ".join(kept)
            removed.append(n)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept.decode("utf-8", "replace"))
        columns = {"row": rows, "n_words": pa.array(words.counts), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(kept_texts, pa.string())} if with_text else {}))

    return S.by_segment(segs, answers.unionByName(exact), remove, out_schema)


_EMPTY_BLOCKS = pa.table({"kind": pa.array([], pa.int32()), "shard": pa.array([], pa.int64()), "seg": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})


def _marked_pairs(a: np.ndarray, b: np.ndarray, shard_bits: int, answers: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(a), bool)
    if not len(a) or not answers:
        return out
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    heads = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
    at = np.flatnonzero(heads)
    shards = (sa[at] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(at), np.int64)
    marked = np.zeros(len(at), bool)
    for shard, data in answers.items():
        lo, hi = np.searchsorted(shards, [shard, shard + 1])
        marked[lo:hi] = np.unpackbits(np.frombuffer(S.release(data), np.uint8))[: hi - lo].astype(bool)
    out[order] = marked[np.cumsum(heads) - 1]
    return out
