"""Documents packed into segments, and sorted key blocks that are merged by key range.

A segment is one row: an id and the compressed texts of consecutive documents. Once written, it is the same for every
pass and every retry, so a pass can send only short codes of what it finds, and a later pass computes the rest again.

Keys (hashes, sketch cells) travel as one block for each segment and shard, a shard being a range of keys: sorted,
distinct within the segment with a mark for "more than once here", as deltas, compressed. Merging a shard tells each
block which of its keys occur twice or more anywhere; the answer is one bit a key. A key that every document holds is so
at most one entry for each segment. The number of shards follows the number of keys, so a merge has a bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import write_shared

SEGMENT_BYTES = 4_000_000
SHARD_KEYS = 2_000_000
MASK = (1 << 64) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE_CODES: dict[int, np.ndarray] = {}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def release(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes: what is small or steady nearly vanishes."""
    if not len(values):
        return squeeze(b"")
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = np.frombuffer(release(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """A published finalizer of 64-bit hashes (shifts and multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _codes(seed: int) -> np.ndarray:
    if seed not in _BYTE_CODES:
        _BYTE_CODES[seed] = np.array([int.from_bytes(hashlib.sha256(bytes([seed, c])).digest()[:8], "little") | 1 for c in range(256)], np.uint64)
    return _BYTE_CODES[seed]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        down[0] = 1
        _POWERS[0] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, step: int = 1 << 21) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes; starts ascend. Memory follows step, not the data.

    A polynomial modulo 2**64: some different strings of 1,024 bytes and more have equal hashes whatever the base, so it
    is for choosing and finding candidates that are compared afterwards. What decides is hashed by sequence_hashes.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + step)))
        a, b = starts[at:to] - low, ends[at:to] - low
        part = data[low : low + int(b.max())]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_codes(seed)[part] * up[: len(part)], out=sums[1:])
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(out)


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """slice_hashes of each n consecutive bytes."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_codes(0)[data] * up[: len(data)], out=sums[1:])
    out = sums[n:] - sums[:-n]
    out *= down[: len(out)]
    out += np.uint64(n * 0xD6E8FEB86659FD93 & MASK)
    return mix64(out)


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xD6E8FEB86659FD93)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(29)
    return x


def sequence_hashes(leaves: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of each n consecutive leaves, mixed pair by pair in a tree: 1, 2, 4 ... leaves, then n's binary digits."""
    if len(leaves) < n:
        return leaves[:0]
    out, done, power, k, rest = None, 0, leaves, 1, n
    while True:
        if rest & 1:
            out, done = (power, k) if out is None else (_combine(out[: len(leaves) - done - k + 1], power[done:]), done + k)
        rest >>= 1
        if not rest:
            return mix64(out + np.uint64(n * 0x9E3779B97F4A7C15 & MASK))
        power, k = _combine(power[:-k], power[k:]), 2 * k


# --- segments -------------------------------------------------------------------------------------------------------


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, total, seq
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            row = pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([total], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue())], pa.binary())], names=["seg", "n_bytes", "data"])
            held, total, seq = [], 0, seq + 1
            return row

        for batch in batches:
            sizes = np.array([len(x) if x is not None else 0 for x in (s.as_buffer() for s in batch.column("_text"))] if batch.num_rows else [])
            at = 0
            while at < batch.num_rows:
                ends = np.cumsum(sizes[at:])
                take = max(1, int(np.searchsorted(ends, size - total, "right")))
                held.append(pa.RecordBatch.from_arrays([c.take(pa.array(range(at, min(at + take, batch.num_rows)))) for c in batch.columns], names=batch.schema.names))
                total += int(ends[min(take, len(ends)) - 1])
                at += take
                if total >= size:
                    yield flush()
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, keep: list[str], text: str, size: int = SEGMENT_BYTES) -> DataFrame:
    """Writes docs as segments (seg, n_bytes, data) to the shared folder. A text longer than a segment gets one of its own."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("_text"))
    return write_shared(rows.mapInArrow(_packer(size), "seg long, n_bytes long, data binary"), "segments")


def unpack(data: bytes) -> tuple[pa.Array, list[bytes]]:
    """(row structs, texts) of a segment."""
    t = pa.ipc.open_stream(release(data)).read_all()
    return t.column("row").combine_chunks(), t.column("_text").to_pylist()


# --- key blocks -----------------------------------------------------------------------------------------------------

BLOCK_SCHEMA = "kind int, shard long, seg long, n long, data binary"
ANSWER_SCHEMA = "kind int, shard long, seg long, data binary"


def key_blocks(keys: np.ndarray, bits: int, shard_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(shard, entries, data) of keys below 2**bits; the upper shard_bits tell the shard. Repeats here are marked."""
    if not len(keys):
        return
    keys = np.sort(keys)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(first)
    uniq = keys[at]
    many = np.diff(np.append(at, len(keys))) > 1
    low_bits = np.uint64(bits - shard_bits)
    shards = (uniq >> low_bits).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shards)) + 1
    low = uniq & np.uint64((1 << int(low_bits)) - 1)
    kind = np.uint32 if bits - shard_bits <= 32 else np.uint64
    for a, b in zip([0, *cuts], [*cuts, len(uniq)], strict=True):
        part = low[a:b].astype(kind)
        part[1:] -= part[:-1].copy()
        yield int(shards[a]), int(b - a), _join(planes(part), squeeze(np.packbits(many[a:b]).tobytes()))


def _join(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def read_block(data: bytes, n: int, kind) -> tuple[np.ndarray, np.ndarray]:
    k = int.from_bytes(data[:4], "little")
    keys = np.cumsum(from_planes(data[4 : 4 + k], np.dtype(kind)), dtype=kind)
    return keys, np.unpackbits(np.frombuffer(release(data[4 + k :]), np.uint8))[:n].astype(bool)


def merge_sketch(width_bits: int) -> Callable:
    """Merges partition sketches of one shard: counters are summed, then each block hears which of its cells reach two."""

    def run(t: pa.Table) -> pa.Table:
        counters = np.zeros(1 << width_bits, np.uint8)
        rows = list(zip(t.column("n").to_pylist(), t.column("data").to_pylist(), strict=True))
        for n, data in rows:
            cells, many = read_block(data, n, np.uint32)
            counters[cells] = np.minimum(2, counters[cells] + 1 + many)
        return _answers(t, [counters[read_block(data, n, np.uint32)[0]] >= 2 for n, data in rows])

    return run


def merge_exact(kind) -> Callable:
    """Merges exact keys of one shard: each block hears which of its keys occur twice or more in all."""

    def run(t: pa.Table) -> pa.Table:
        parts = [read_block(data, n, kind) for n, data in zip(t.column("n").to_pylist(), t.column("data").to_pylist(), strict=True)]
        keys = np.concatenate([p[0] for p in parts])
        weight = np.concatenate([p[1] for p in parts]).astype(np.uint8) + 1
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.add.reduceat(weight[order].astype(np.int64), heads)
        twice = np.empty(len(keys), bool)
        twice[order] = np.repeat(total >= 2, np.diff(np.append(heads, len(keys))))
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return _answers(t, np.split(twice, cuts))

    return run


def _answers(t: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    some = [i for i, f in enumerate(flags) if f.any()]
    kept = t.take(pa.array(some, pa.int64()))
    return pa.table({"kind": kept.column("kind"), "shard": kept.column("shard"), "seg": kept.column("seg"), "data": pa.array([squeeze(np.packbits(flags[i]).tobytes()) for i in some], pa.binary())})


def apply_answers(keys: np.ndarray, bits: int, shard_bits: int, answers: dict[int, bytes]) -> np.ndarray:
    """True for each of this segment's keys that its shard's answer marks."""
    out = np.zeros(len(keys), bool)
    if not len(keys) or not answers:
        return out
    uniq, where = np.unique(keys, return_inverse=True)
    marked = np.zeros(len(uniq), bool)
    shards = (uniq >> np.uint64(bits - shard_bits)).astype(np.int64)
    for shard, data in answers.items():
        a, b = np.searchsorted(shards, [shard, shard + 1])
        marked[a:b] = np.unpackbits(np.frombuffer(release(data), np.uint8))[: b - a].astype(bool)
    return marked[where]


def shard_bits_for(keys: int) -> int:
    return max(0, (max(1, keys // SHARD_KEYS) - 1).bit_length())


def by_segment(segments: DataFrame, answers: DataFrame, fn: Callable[[int, bytes, dict[int, dict[int, bytes]]], pa.Table], schema) -> DataFrame:
    """Brings each segment together with the answers to it and applies fn(seg, data, {kind: {shard: answer}})."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, dict[int, bytes]] = {}
        for kind, shard, data in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("data").to_pylist(), strict=True):
            found.setdefault(kind, {})[shard] = data
        return pa.concat_tables(fn(seg, x, found) for seg, x in zip(left.column("seg").to_pylist(), left.column("data").to_pylist(), strict=True))

    def guarded(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows else empty

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    return segments.select("seg", "data").groupBy("seg").cogroup(answers.select("seg", "kind", "shard", "data").groupBy("seg")).applyInArrow(guarded, schema)
