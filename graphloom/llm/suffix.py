"""Suffix-array deduplication by deep-shallow sorting (operator 4).

Every byte that a repeated string of `length` bytes covers is removed. Sorting the suffixes at all places is not needed:
each string of `length` bytes is tied to one anchor in it, the place of the smallest hash of ANCHOR bytes, which only the
string's own bytes decide, so equal strings have their anchors at equal offsets. Anchors whose ANCHOR bytes are nowhere
else are dropped. The rest travel, by that hash, with the bytes around them, and a shard sorts the suffixes that start at
its anchors, and the reversed prefixes that end there, by deep-shallow sorting: a multikey quicksort over 8-byte
characters to SHALLOW bytes, then a blind trie for each group that still ties. In sorted order with its longest common
prefixes, strings that agree in `a` bytes before the anchor and `length - a` bytes from it are found for every a; these
are the repeated strings, exactly.

Sorting is distributed: a shard's size follows SHARD_ANCHORS, and equal surroundings are sent once for each segment.

Defined cases: a null text is empty; a text of fewer than `length` bytes loses nothing; rows that repeat lose what is
`length` bytes or more; matches never cross rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import segments as S
from graphloom.session import write_shared

LENGTH = 200
ANCHOR = 100
SHALLOW = 32  # bytes that the quicksort looks at
SHARD_ANCHORS = 150_000
STEP = 1 << 20  # bytes hashed at a time


# --- deep-shallow sorting -------------------------------------------------------------------------------------------


def multikey_quicksort(keys: np.ndarray, small: int = 4096) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of rows of 8-byte characters, and the ranges of the order whose rows are equal in all of them.

    Ranges of at most `small` rows are put off and sorted in one last pass, all together, by range and characters.
    """
    n, depth = keys.shape
    order = np.arange(n)
    put_off: list[tuple[int, int]] = []
    stack = [(0, n, 0)]
    while stack:
        lo, hi, at = stack.pop()
        if hi - lo < 2 or at == depth:
            continue
        if hi - lo <= small:
            put_off.append((lo, hi))
            continue
        part = order[lo:hi]
        col = keys[part, at]
        pivot = np.sort(col[[0, len(col) // 2, -1]])[1]
        less, more = col < pivot, col > pivot
        a, c = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        stack += [(lo, lo + a, at), (lo + a, hi - c, at + 1), (hi - c, hi, at)]
    if put_off:
        put_off.sort()
        places = np.concatenate([np.arange(lo, hi) for lo, hi in put_off])
        part = order[places]
        order[places] = part[np.lexsort((*keys[part].T[::-1], np.repeat(np.arange(len(put_off)), [hi - lo for lo, hi in put_off])))]
    ordered = keys[order]
    cuts = [0, *(np.flatnonzero((ordered[1:] != ordered[:-1]).any(axis=1)) + 1).tolist(), n]
    return order, [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Strings by the byte at which they branch: inner nodes keep a depth and children by byte, leaves keep strings.

    A search reads branching bytes only, so it may end at a wrong leaf; one comparison with that leaf's string tells
    where the new string belongs. A string that ends at a node's depth is its child under -1.
    """

    def __init__(self, first: bytes):
        self.root: list = [None, first, None]  # [depth or None for a leaf, string, children]
        self.leaves = 1

    def insert(self, s: bytes) -> None:
        node = self.root
        while node[0] is not None:
            d = node[0]
            node = node[2].get(s[d] if d < len(s) else -1) or next(iter(node[2].values()))
        other = node[1]
        if other == s:
            return
        at = _common(s, other)
        node = self.root
        while node[0] is not None and node[0] < at:
            node = node[2][s[node[0]] if node[0] < len(s) else -1]
        mine = s[at] if at < len(s) else -1
        leaf = [None, s, None]
        if node[0] == at:
            node[2][mine] = leaf
        else:
            node[:] = [at, None, {(other[at] if at < len(other) else -1): node[:], mine: leaf}]
        self.leaves += 1

    def sorted(self) -> tuple[list[bytes], list[int]]:
        """The strings in order, and the common prefix of each with the one before (0 for the first)."""
        strings: list[bytes] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if node[0] is None:
                strings.append(node[1])
                common.append(shared)
                continue
            keys = sorted(node[2], reverse=True)
            for i, k in enumerate(keys):
                stack.append((node[2][k], node[0] if i < len(keys) - 1 else shared))
        return strings, common


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the strings' order, and the common prefix of each with the one before it in that order. head: their first `shallow` bytes, a row each, filled up with 0."""
    n = len(strings)
    if head is None:
        head = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), np.uint8).reshape(n, shallow)
    order, ties = multikey_quicksort(np.ascontiguousarray(head).view(">u8").astype(np.uint64))
    lcp = np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    for lo, hi in ties:
        inside[lo + 1 : hi] = True
        group = order[lo:hi].tolist()
        members: dict[bytes, list[int]] = {}
        for i in group:
            members.setdefault(strings[i], []).append(i)
        first, *rest = members
        trie = BlindTrie(first)
        for s in rest:
            trie.insert(s)
        at = lo
        for s, shared in zip(*trie.sorted(), strict=True):
            same = members[s]
            order[at : at + len(same)] = same
            lcp[at] = shared
            lcp[at + 1 : at + len(same)] = len(s)
            at += len(same)
    apart = np.flatnonzero(~inside)[1:]  # these differ from the one before in the head
    sizes = np.fromiter(map(len, strings), np.int64, n)[order]
    lcp[apart] = np.minimum((head[order[apart]] != head[order[apart - 1]]).argmax(axis=1), np.minimum(sizes[apart], sizes[apart - 1]))
    return order, lcp


# --- anchors --------------------------------------------------------------------------------------------------------


_NOWHERE = np.uint64((1 << 64) - 1)  # of a least hash and place, which has a smaller place


def _sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from minima of blocks, in three passes."""
    n = len(values)
    rows = -(-n // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    grid = full.reshape(rows, w)
    forth = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], forth[w - 1 : n])


class Anchored:
    """The anchors of a segment's texts: their places, the hash of their ANCHOR bytes and their text's bounds."""

    def __init__(self, texts: list[bytes], length: int, anchor: int):
        self.texts = texts
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.firsts = np.concatenate([[0], ends]).astype(np.int64)
        w = length - anchor + 1
        places, hashes = [], []
        for lo, hi in self._stretches(length):
            if hi - lo < length:
                continue
            h = S.window_hashes(self.data[lo:hi], anchor)
            # the hash's upper bits, then the place, decide: of equal hashes the first is the anchor
            least = _sliding_min((h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), w)
            for d in range(*(np.searchsorted(ends, [lo, hi - 1], "right") + [0, 1])):  # strings that end in another text have no anchor
                least[max(0, int(ends[d]) - length + 1 - lo) : max(0, int(ends[d]) - lo)] = _NOWHERE
            at = least[least != _NOWHERE]
            at = (at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at) & np.uint64(0xFFFFFF)
            places.append(at.astype(np.int64) + lo)
            hashes.append(h[places[-1] - lo])
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        keys = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)  # they ascend; parts of a text may share one
        self.at = at[first]
        self.keys = S.mix64(keys[first] ^ np.uint64(0x9FB21C651E98DF25))  # anchors have small hashes; shards need even ones
        of = np.searchsorted(ends, self.at, "right")
        self.left = np.minimum(self.at - self.firsts[of], length - anchor)
        self.right = np.minimum(self.firsts[of + 1] - self.at, length)

    def _stretches(self, length: int):
        """Parts of about STEP bytes: whole texts where they fit, overlapping parts of a text where not."""
        lo = 0
        for d in range(len(self.texts)):
            end = int(self.firsts[d + 1])
            if end - lo >= STEP:
                at = lo
                while end - at > 2 * STEP:
                    yield at, at + STEP + length - 1
                    at += STEP
                yield at, end
                lo = end
        if lo < len(self.data):
            yield lo, len(self.data)


def _surroundings(x: Anchored, some: np.ndarray, before: int, length: int) -> np.ndarray:
    """Rows of `before` bytes up to the anchor and `length` bytes from it; what lies outside the text is 0."""
    around = np.concatenate([np.zeros(before, np.uint8), x.data, np.zeros(length, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(around, before + length)[x.at[some]]
    left, right = x.left[some], x.right[some]
    cut = np.flatnonzero((left < before) | (right < length))
    span = np.arange(-before, length)
    rows[cut] *= (span >= -left[cut][:, None]) & (span < right[cut][:, None])
    return rows


def _distinct(x: Anchored, some: np.ndarray, before: int, length: int):
    """(rows, left, right, counts, group of each): equal surroundings once."""
    rows = _surroundings(x, some, before, length)
    full = np.concatenate([rows, x.left[some].astype("<u2").view(np.uint8).reshape(-1, 2), x.right[some].astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
    _, first, group, counts = np.unique(np.ascontiguousarray(full).view(f"V{full.shape[1]}").reshape(-1), return_index=True, return_inverse=True, return_counts=True)
    return rows[first], x.left[some][first], x.right[some][first], counts, group


def _head(rows: np.ndarray) -> np.ndarray:
    """The first SHALLOW bytes of each row, filled up with 0."""
    return np.ascontiguousarray(np.pad(rows[:, :SHALLOW], ((0, 0), (0, max(0, SHALLOW - rows.shape[1])))))


def repeated_offsets(rows: np.ndarray, left: np.ndarray, right: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """For each row and each a in [0, before]: does the string from a bytes before the anchor start elsewhere too?"""
    before = rows.shape[1] - length
    flat = rows.tobytes()
    width = rows.shape[1]
    ahead, back = [], []
    for i, (le, ri) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        mid = i * width + before
        ahead.append(flat[mid : mid + ri])
        back.append(flat[mid - le : mid][::-1])
    order, lcp = deep_shallow(ahead, head=_head(rows[:, before:]))
    order_b, lcp_b = deep_shallow(back, head=_head(rows[:, :before][:, ::-1]))
    out = np.zeros((len(rows), before + 1), bool)
    rank = np.empty(len(rows), np.int64)
    rank_b = np.empty(len(rows), np.int64)
    for a in range(before + 1):
        fit = np.flatnonzero((left >= a) & (right >= length - a))
        if not len(fit):
            continue
        rank[order] = np.cumsum(lcp < length - a)
        rank_b[order_b] = np.cumsum(lcp_b < a)
        pair = rank[fit] * (len(rows) + 1) + rank_b[fit]
        by = np.argsort(pair, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], pair[by][1:] != pair[by][:-1]]))
        total = np.add.reduceat(counts[fit][by], heads)
        out[fit[by], a] = np.repeat(total > 1, np.diff(np.append(heads, len(by))))
    return out


def _runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked offsets: (places in group, first offset, last offset) for the row of flags that each place of group names."""
    edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    n = np.bincount(row, minlength=len(flags))
    before, mine = np.cumsum(n) - n, n[group]
    which = np.repeat(np.arange(len(group)), mine)
    at = np.arange(len(which)) + np.repeat(before[group] - (np.cumsum(mine) - mine), mine)
    return which, first[at], last[at]


# --- the operator ---------------------------------------------------------------------------------------------------

ANCHOR_KIND, CONTEXT_KIND = 0, 1


def _anchor_blocks(length: int, anchor: int, shard_bits: int):
    def run(batches):
        for batch in batches:
            for seg, data in zip(batch.column("seg").to_pylist(), batch.column("data").to_pylist(), strict=True):
                keys = Anchored(S.unpack(data)[1], length, anchor).keys
                rows = [(ANCHOR_KIND, shard, seg, n, block) for shard, n, block in S.key_blocks(keys, 64, shard_bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    return run


_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ["kind", "shard", "seg", "n", "data"]


def _by_shard(x: Anchored, found: dict, shard_bits: int, context_bits: int) -> dict[int, np.ndarray]:
    """The segment's anchors that are somewhere else too, by the shard that sorts them."""
    some = np.flatnonzero(S.apply_answers(x.keys, 64, shard_bits, found.get(ANCHOR_KIND, {})))
    shards = (x.keys[some] >> np.uint64(64 - context_bits)).astype(np.int64) if context_bits else np.zeros(len(some), np.int64)
    by = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[by])) + 1
    return {int(shards[p[0]]): some[p] for p in np.split(by, cuts) if len(p)}


def deduplicate(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH, anchor: int | None = None, with_text: bool = True) -> DataFrame:
    """Columns row (docs' columns, or those in keep), n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes (what is left, as binary)."""
    keep = keep or docs.columns
    anchor = anchor or min(ANCHOR, length // 2)
    before = length - anchor
    segs = S.pack(docs, keep, text)
    size = int(segs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    expected = max(1, 2 * size // (before + 2))
    shard_bits = S.shard_bits_for(expected)
    blocks = segs.select("seg", "data").mapInArrow(_anchor_blocks(length, anchor, shard_bits), S.BLOCK_SCHEMA)
    answers = write_shared(blocks.groupBy("kind", "shard").applyInArrow(S.merge_exact(np.uint64 if 64 - shard_bits > 32 else np.uint32), S.ANSWER_SCHEMA), "anchors")
    context_bits = (max(1, expected // SHARD_ANCHORS) - 1).bit_length()

    def contexts(seg: int, data: bytes, found: dict) -> pa.Table:
        x = Anchored(S.unpack(data)[1], length, anchor)
        out = []
        for shard, some in _by_shard(x, found, shard_bits, context_bits).items():
            rows, left, right, counts, _ = _distinct(x, some, before, length)
            body = rows.tobytes() + left.astype("<u2").tobytes() + right.astype("<u2").tobytes() + np.minimum(counts, 2).astype(np.uint8).tobytes()
            out.append((CONTEXT_KIND, shard, seg, len(rows), S.squeeze(body)))
        columns = zip(*out, strict=True) if out else ((),) * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    def sort_shard(t: pa.Table) -> pa.Table:
        parts = []
        for n, data in zip(t.column("n").to_pylist(), t.column("data").to_pylist(), strict=True):
            raw = np.frombuffer(S.release(data), np.uint8)
            w = before + length
            parts.append((raw[: n * w].reshape(n, w), raw[n * w : n * (w + 2)].view("<u2").astype(np.int64), raw[n * (w + 2) : n * (w + 4)].view("<u2").astype(np.int64), raw[n * (w + 4) :].astype(np.int64)))
        flags = repeated_offsets(*(np.concatenate(p) for p in zip(*parts, strict=True)), length)
        pieces = np.split(flags, np.cumsum([len(p[0]) for p in parts])[:-1])
        some = [i for i, f in enumerate(pieces) if f.any()]
        kept = t.take(pa.array(some, pa.int64()))
        return pa.table({"kind": kept.column("kind"), "shard": kept.column("shard"), "seg": kept.column("seg"), "data": pa.array([S.squeeze(np.packbits(pieces[i], axis=1).tobytes()) for i in some], pa.binary())})

    sent = S.by_segment(segs, answers, contexts, T._parse_datatype_string(S.BLOCK_SCHEMA))
    verdicts = sent.groupBy("kind", "shard").applyInArrow(sort_shard, S.ANSWER_SCHEMA)
    fields = [T.StructField("row", docs.select(*[f"`{c}`" for c in keep]).schema), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + ([T.StructField("kept_bytes", T.BinaryType())] if with_text else []))

    def remove(_: int, data: bytes, found: dict) -> pa.Table:
        rows, texts = S.unpack(data)
        gone = np.zeros(sum(map(len, texts)) + 1, np.int32)
        if found.get(CONTEXT_KIND):
            x = Anchored(texts, length, anchor)
            for shard, some in _by_shard(x, found, shard_bits, context_bits).items():
                if shard not in found[CONTEXT_KIND]:
                    continue
                group = _distinct(x, some, before, length)[4]
                bits = np.frombuffer(S.release(found[CONTEXT_KIND][shard]), np.uint8).reshape(-1, (before + 8) // 8)
                which, a, b = _runs(np.unpackbits(bits, axis=1)[:, : before + 1], group)
                np.add.at(gone, x.at[some][which] - b, 1)
                np.subtract.at(gone, x.at[some][which] - a + length, 1)
        gone = np.cumsum(gone) > 0
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")}
        ends = np.cumsum([0, *map(len, texts)])
        begins = gone[:-1].copy()
        begins[1:] &= ~gone[:-2]
        firsts = ends[ends < len(begins)]
        begins[firsts] = gone[firsts]  # a run ends with its text
        removed, spans = (np.diff(np.concatenate([[0], np.cumsum(f, dtype=np.int64)])[ends]).tolist() for f in (gone[:-1], begins))
        for t, at, n, k in zip(texts, ends.tolist(), removed, spans, strict=False):
            kept = np.frombuffer(t, np.uint8)[~gone[at : at + len(t)]].tobytes() if n else t
            for name, v in zip(out, (len(t), n, k, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                out[name].append(v)
        columns = {"row": rows} | {k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        return pa.table(columns | ({"kept_bytes": pa.array(out["kept_bytes"], pa.binary())} if with_text else {}))

    return S.by_segment(segs, answers.unionByName(verdicts), remove, schema)
