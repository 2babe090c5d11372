"""Token-ID output in patched frame-of-reference blocks (operator 7).

Documents are range-partitioned and sorted by id, encoded with a public tokenizer (one end id after each document) and
written as files in the shared folder. A file holds blocks of BLOCK ids: the block minimum is subtracted, the rest is
packed at the width that a percentile of the block needs, and larger values go to the block's exception list. An index
holds where each block starts, so a range of ids is read alone (read_range).

File layout, little-endian: magic "GLTK", u32 version, u64 ids, u64 documents, u64 blocks; the blocks (u32 minimum, u8
width, u16 exceptions, packed bits, exception places u16, exception values u32); u64 start of each block; i64 id, u8 is-null and
u32 length of each document; u64 place of the index, magic.

Lost executors: a file gets a name of its own attempt and counts only if the written manifest lists it.
Defined cases: a null text is empty, its only id is the end id; null ids come first; rows with equal ids are ordered by
text; a text of any length is encoded whole and stays in one file; only the id and the text are read, so other columns,
whatever their names, have no part; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import fresh_path, write_shared

BLOCK = 1024
PERCENTILE = 90
MAGIC = b"GLTK"
FILE_IDS = 4_000_000  # ids in a file, at most STEP_BYTES of text or one document more
STEP_BYTES = 8_000_000  # of texts that are encoded at a time
CACHE = 250_000  # words in each of the two generations that a worker remembers
END_ID = 1


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values to rows of bytes, width bits a value."""
    wide = np.dtype(">u2") if width <= 16 else np.dtype(">u4")
    bits = np.unpackbits(values.astype(wide).view(np.uint8).reshape(*values.shape, wide.itemsize), axis=2)
    return np.packbits(bits[:, :, wide.itemsize * 8 - width :].reshape(len(values), -1), axis=1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    wide = np.dtype(">u2") if width <= 16 else np.dtype(">u4")
    bits = np.zeros((len(packed), BLOCK, wide.itemsize * 8), np.uint8)
    bits[:, :, wide.itemsize * 8 - width :] = np.unpackbits(packed, axis=1)[:, : BLOCK * width].reshape(len(packed), BLOCK, width)
    return np.packbits(bits, axis=2).reshape(len(packed), -1).view(wide).astype(np.uint32)


def encode_ids(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of uint32 ids and the number of bytes of each."""
    n = -(-len(ids) // BLOCK)
    blocks: list[bytes] = [b""] * n
    step = 512
    for at in range(0, n, step):
        part = ids[at * BLOCK : (at + step) * BLOCK]
        rows = -(-len(part) // BLOCK)
        full = np.full(rows * BLOCK, part[-1], np.uint32)
        full[: len(part)] = part
        full = full.reshape(rows, BLOCK)
        low = full.min(axis=1)
        rest = full - low[:, None]
        kth = BLOCK * PERCENTILE // 100
        widths = np.array([max(1, int(x).bit_length()) for x in np.partition(rest, kth, axis=1)[:, kth]])
        odd = rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
        for width in np.unique(widths):
            rows_at = np.flatnonzero(widths == width)
            packed = _pack(np.where(odd[rows_at], 0, rest[rows_at]), int(width))
            for r, bits in zip(rows_at, packed, strict=True):
                places = np.flatnonzero(odd[r])
                blocks[at + r] = struct.pack("<IBH", low[r], width, len(places)) + bits.tobytes() + places.astype("<u2").tobytes() + rest[r, places].astype("<u4").tobytes()
    return blocks, np.array([len(b) for b in blocks], np.uint64)


def encode_file(doc_ids: list[int | None], lengths, ids: np.ndarray) -> bytes:
    blocks, sizes = encode_ids(ids)
    head = struct.pack("<4sIQQQ", MAGIC, 1, len(ids), len(doc_ids), len(blocks))
    starts = len(head) + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<u8") if len(blocks) else np.zeros(0, "<u8")
    place = len(head) + int(sizes.sum())
    index = starts.astype("<u8").tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes() + np.array(lengths, "<u4").tobytes()
    return b"".join([head, *blocks, index, struct.pack("<Q4s", place, MAGIC)])


def decode_blocks(data: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of consecutive blocks that start at the given places."""
    out = np.empty((len(starts), BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBH", data, int(s)) for s in starts]
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        size = BLOCK * int(width) // 8
        for some in np.array_split(rows, -(-len(rows) // 512)):
            packed = np.stack([np.frombuffer(data, np.uint8, size, int(starts[r]) + 7) for r in some])
            out[some] = _unpack(packed, int(width))
        for r in rows:
            if k := heads[r][2]:
                at = int(starts[r]) + 7 + size
                out[r, np.frombuffer(data, "<u2", k, at)] = np.frombuffer(data, "<u4", k, at + 2 * k)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    return out.reshape(-1)[:n_ids]


def decode_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(ids of documents, lengths, ids) of a file."""
    magic, _, n_ids, n_docs, n_blocks = struct.unpack_from("<4sIQQQ", data)
    place, last = struct.unpack_from("<Q4s", data, len(data) - 12)
    if magic != MAGIC or last != MAGIC:
        raise ValueError("not a token file, or cut short")
    starts = np.frombuffer(data, "<u8", n_blocks, place)
    docs = np.frombuffer(data, "<i8", n_docs, place + 8 * n_blocks)
    nulls = np.frombuffer(data, np.uint8, n_docs, place + 8 * (n_blocks + n_docs))
    lengths = np.frombuffer(data, "<u4", n_docs, place + 8 * n_blocks + 9 * n_docs)
    ids = decode_blocks(data, starts, n_ids) if n_blocks else np.zeros(0, np.uint32)
    return [None if n else int(d) for d, n in zip(docs, nulls, strict=True)], lengths, ids


_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")  # ' starts contractions
# The normalizer and the pieces for which a text's ids are those of its words in order.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Little-endian uint32 ids of whole texts, asking the tokenizer once for each distinct word.

    Holds for a lower-casing tokenizer whose pieces never cross white space or the end of letters, and whose every piece
    ends in an id of its own kind; is_by_words() looks whether the file says so. Any other tokenizer encodes whole texts.
    Words are remembered in two generations of at most `size` parts each, so memory is bounded and what is frequent stays.
    """

    def __init__(self, vocabulary: str, size: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.by_words = self.is_by_words(json.loads(self.tokenizer.to_str()))
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.is_end = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.is_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def is_by_words(config: dict) -> bool:
        normal, pieces = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
        first = (pieces.get("pretokenizers") or [{}])[0]
        return (
            [x["type"] for x in normal.get("normalizers", [])] == _NORMALIZERS
            and first.get("type") == "Split"
            and first["pattern"].get("Regex") == _PIECES
            and (first["behavior"], first["invert"]) == ("Removed", True)
            and config["model"].get("end_of_word_suffix") == "</w>"
        )

    def _ask(self, strings: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _ask_letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters only, many in one call; the ids that end a piece tell the words apart."""
        for at in range(0, len(words), 200):
            some = words[at : at + 200]
            raw = self._ask([" ".join(some)])[0]
            ends = np.flatnonzero(self.is_end[np.frombuffer(raw, "<u4")]) + 1
            if len(ends) != len(some):  # a word has a second piece, as lower-casing may part letters from their marks
                yield from self._ask(some)
                continue
            cuts = (4 * ends).tolist()
            yield from (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False))

    def _known(self, strings: list[str]) -> list[str]:
        """Those of distinct strings that no generation holds; what only the old one holds moves to the young one."""
        young, old = self.young, self.old
        absent = [s for s, have in zip(strings, map(young.get, strings), strict=True) if have is None]
        again = [(s, have) for s, have in zip(absent, map(old.get, absent), strict=True) if have is not None]
        young.update(again)
        return [s for s in absent if s not in young] if again else absent

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words without white space: of their letters and of the marks after them, else of the whole."""
        young = self.young
        new, letters, rest = [], [], []
        for w in self._known(words):
            if w.isalpha():
                letters.append(w)
            elif (head := w.rstrip(_MARKS)).isalpha():
                new.append((w, head, w[len(head) :]))
            else:
                rest.append(w)
        heads = self._known(list({x[1] for x in new}.difference(letters)))
        letters += heads
        young.update(zip(letters, self._ask_letters(letters), strict=True))
        rest += self._known(list({x[2] for x in new}.difference(rest)))
        young.update(zip(rest, self._ask(rest), strict=True))
        young.update((w, young[a] + young[b]) for w, a, b in new)
        out = list(map(young.__getitem__, words))
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; number of ids of each)."""
        if not self.by_words:
            got = self._ask([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(got), "<u4"), np.array([len(g) // 4 for g in got], np.int64)
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are found before lower-casing
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known = self._ids(coded.dictionary.to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(k) // 4 for k in known])]).astype(np.int32)
        pool = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(known), "<u4")))
        ids = pool.take(coded.indices).flatten().to_numpy()
        per_word = np.concatenate([[0], np.cumsum(np.diff(offsets)[coded.indices.to_numpy()], dtype=np.int64)])
        edges = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, np.diff(per_word[edges])


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column holds about `most` bytes, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


_ENCODER: list = [None, None]  # of this worker: (vocabulary, size) and the one encoder that it keeps


def _encoder(vocabulary: str, words: int = CACHE) -> WordEncoder:
    """The worker's encoder. Looked up here, as what a nested function refers to is sent anew with every task."""
    if _ENCODER[0] != (vocabulary, words):
        _ENCODER[:] = [(vocabulary, words), WordEncoder(vocabulary, words)]
    return _ENCODER[1]


def _writer(folder: str, vocabulary: str, end_id: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = _encoder(vocabulary, words)
        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get().partitionId()
        docs: list = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held, seq = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, lengths, parts, held, seq
            store.create_dir(base, recursive=True)
            path = f"{base}/{task:08d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
            data = encode_file(docs, np.concatenate(lengths), np.concatenate(parts))
            with store.open_output_stream(path) as f:
                f.write(data)
            row = pa.RecordBatch.from_pydict({"task": [task], "seq": [seq], "path": [path.rsplit("/", 1)[1]], "n_docs": [len(docs)], "n_ids": [held], "n_bytes": [len(data)]})
            docs, lengths, parts, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for some in by_bytes(batch, "text", STEP_BYTES):
                ids, counts = encoder(some.column("text"))
                docs += some.column("doc_id").to_pylist()
                lengths.append(counts + 1)
                parts.append(np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32))
                held += len(parts[-1])
                if held >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, folder: str | None = None, words: int = CACHE) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and the manifest: task, seq, path, n_docs, n_ids, n_bytes (files in order of task, seq)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = ordered.mapInArrow(_writer(folder, vocabulary, end_id, words), "task long, seq long, path string, n_docs long, n_ids long, n_bytes long")
    return folder, write_shared(manifest, "token-manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{path}") as f:
                    docs, lengths, ids = decode_file(f.read())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files that the manifest lists.

    Starts are prefix sums in two levels: over the writing tasks, of which there is one row each, and within each task.
    """
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("_ids"))
    tasks = tasks.select("task", F.coalesce(F.sum("_ids").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = W.partitionBy("task").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(tasks, "task")
    files = files.select("path", (F.col("_before") + F.col("_within")).cast("long").alias("start"))
    spread = min(20_000, max(1, manifest.count()))  # a number given keeps files apart that look small as rows
    return files.repartition(spread, "path").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(folder: str, path: str, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of one file. Reads its head, its index and the blocks that hold them, nothing else."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{path}") as f:
        n_ids, _, n_blocks = struct.unpack("<QQQ", f.read_at(24, 8))
        place = struct.unpack("<Q", f.read_at(8, f.size() - 12))[0]
        first, last = max(0, first), min(last, n_ids)
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        edges = np.append(np.frombuffer(f.read_at(8 * n_blocks, place), "<u8"), place)[a : b + 1].astype(np.int64)
        data = f.read_at(int(edges[-1] - edges[0]), int(edges[0]))
    return decode_blocks(data, edges[:-1] - edges[0], (b - a) * BLOCK)[first - a * BLOCK : last - a * BLOCK]
