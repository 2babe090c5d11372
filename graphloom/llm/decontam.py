"""Benchmark decontamination (operator 2): one Aho-Corasick automaton over normalised benchmark windows.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. The automaton holds each
window of `window` consecutive item words (an item of fewer words is one window), its letters being words by number. One
scan of a document's words finds every occurrence as a window's number; items are resolved once a document, and word
numbers map the hits back to code-point offsets of the original text. It is one map over the documents without a shuffle.

The benchmark is the query set of a search: its size is measured first. Up to MAX_WORDS words it is one automaton. Beyond
that it is cut by item, and the automata scan one after another, each letting go of the one before, with the same result.

Defined cases: a null text has no words and no hits; an item without words has no window; rows of the benchmark that share
an id are one item, each row with a null id is an item of its own, shown as the empty id; equal windows of several items
count for each of them; a text of any length is scanned whole; repeated rows get equal results; docs' columns travel in a
struct, so their names clash with nothing; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import write_shared

MAX_WORDS = 400_000  # item words in one automaton: some 4 million nodes, 300 MB

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def fold(text: str | None) -> bytes:
    """The normalised text: words joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def windows(words: list, window: int) -> Iterator[tuple]:
    for i in range(max(1, len(words) - window + 1) if words else 0):
        yield tuple(words[i : i + window])


class Scanner:
    """The automaton over the windows of some items. Its letters are words by number; 0 stands for every word of no item."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.ids: list[str | None] = []  # an id once, a null id for each of its items
        self.holders: list[list[int]] = []  # of each window, places in ids
        place: dict[str, int] = {}
        known: dict[tuple[int, ...], int] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in fold(text).split()]
            if not words:
                continue
            at = len(self.ids) if item is None else place.setdefault(item, len(self.ids))
            if at == len(self.ids):
                self.ids.append(item)
            for w in windows(words, window):
                number = known.setdefault(w, len(self.holders))
                if number == len(self.holders):
                    self.holders.append([])
                if not self.holders[number] or self.holders[number][-1] != at:
                    self.holders[number].append(at)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, number in known.items():
            self.automaton.add_word(w, (len(w), number))
        self.empty = not known
        if known:
            self.automaton.make_automaton()

    def scan(self, folded: bytes) -> tuple[int, list[tuple[int, int]], list[str | None]]:
        """(words, runs of hit words as (first, last), ids of the items whose windows occur)."""
        words = folded.split()
        if self.empty or not words:
            return len(words), [], []
        found = list(self.automaton.iter(tuple([self.numbers.get(w, 0) for w in words])))
        runs: list[tuple[int, int]] = []
        for first, last in sorted({(end - n + 1, end) for end, (n, _) in found}):
            if runs and first <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], max(runs[-1][1], last))
            else:
                runs.append((first, last))
        held = {x for number in {number for _, (_, number) in found} for x in self.holders[number]}
        return len(words), runs, [self.ids[x] for x in held]


_SCANNER: list = [None, None]  # of this worker: the name of a broadcast, and the one automaton that it keeps


def _scanner(key: str, items, window: int) -> Scanner:
    if _SCANNER[0] != key:
        _SCANNER[:] = [None, None]
        _SCANNER[:] = [key, Scanner(items.value, window)]
    return _SCANNER[1]


def _merge_runs(runs: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan(items, window: int, key: str, more: bool, last: bool):
    """more: runs and items of other automata are there already. last: runs become offsets of the original text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, items, window)
        for batch in batches:
            counts, covered, ids, spans = [], [], [], []
            texts = batch.column("_text").to_pylist()
            for i, text in enumerate(texts):
                n, runs, mine = scanner.scan(fold(text))
                if more:
                    runs = _merge_runs(batch.column("spans")[i].as_py() + [{"start": a, "end": b} for a, b in runs])
                    had = batch.column("items")[i].as_py()
                    mine = had + [x for x in mine if x is None or x not in set(had)]
                counts.append(n)
                covered.append(sum(b - a + 1 for a, b in runs))
                if last:
                    places = [m.span() for m in _WORD.finditer(text)] if runs else []
                    runs = [(places[a][0], places[b][1]) for a, b in runs]
                    mine = sorted(x or "" for x in mine)
                ids.append(mine)
                spans.append([{"start": a, "end": b} for a, b in runs])
            arrays = [batch.column("row"), pa.array(counts, pa.int64()), pa.array(covered, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names = ["row", "n_words", "n_hit", "items", "spans"]
            yield pa.RecordBatch.from_arrays(arrays if last else [*arrays, batch.column("_text")], names=names if last else [*names, "_text"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Columns row (docs' columns, or those in keep), n_words, n_hit, items (ids as strings, sorted) and spans.

    spans are the hit runs as code-point offsets of the original text, end exclusive.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    words = items.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(_WORD.pattern))), F.lit(0))).first()[0]
    shards = max(1, -(-int(words) // MAX_WORDS))
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row")
    out = docs.select(row, F.col(f"`{text}`").alias("_text"))
    found = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)]
    row_field, text_field = out.schema.fields
    for shard in range(shards):
        part = items.filter(F.pmod(F.when(F.col("i").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("i")), F.lit(shards)) == shard) if shards > 1 else items
        sent = spark.sparkContext.broadcast([(r.i, r.t) for r in part.toLocalIterator()])  # bounded by MAX_WORDS
        last = shard == shards - 1
        out = out.mapInArrow(_scan(sent, window, uuid.uuid4().hex, shard > 0, last), T.StructType([row_field, *found] + ([] if last else [text_field])))
        if not last:  # one automaton is alive at a time, and its items are let go
            out = write_shared(out, "leaks")
            sent.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    return find_leaks(docs, benchmark, text, window=window).filter("n_hit = 0").select("row.*")
