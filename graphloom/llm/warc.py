"""WARC archives with one Zstandard dictionary a file (operator 9).

A file starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from pieces of all records of that
file; every record after it is a Zstandard frame of its own, made with the dictionary. Records with equal payloads of at
least MIN_REVISIT bytes are archived once: the one with the smallest page id is a response, the others are revisits that
refer to its record id, and keep its digest and length but no payload.

The record id of a response that others may refer to follows from digest and page id, so a revisit in another file knows
it; all other ids follow from the file and the place in it.

Lost executors: a file gets a name of its own attempt and counts only if the written manifest lists it.
Defined cases: a null page has an empty payload; rows that repeat both the payload and the page id of a response are
responses too (within a file only the first has the id that is referred to); a null page id never becomes the one
referred to unless all rows of its payload have none, which then are all responses; a page of any length is one record;
a file too small to train on gets what it holds, cut into pieces, as its dictionary; only page id, url and html are read,
so other columns, whatever their names, have no part; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import fresh_path, write_shared

MIN_REVISIT = 100
DICTIONARY_BYTES = 32_768
SAMPLE_BYTES = 1_500_000  # of pieces that a file's dictionary is built from
MIN_PIECE = 64
FILE_BYTES = 24_000_000  # of records in a file before compression
LEVEL = 6
SKIPPABLE = 0x184D2A5D


def response_id(digest: str, page_id: int | None) -> str:
    """The record id of the response that pages with this payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'payload:{digest}:page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, record_id: str, date: str) -> bytes:
    """A WARC/1.1 record. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = re.sub(r"[\r\n\x00]+", " ", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Page-ID: {'null' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {response_id(digest, refers_to)}", f"WARC-Refers-To-Page-ID: {'null' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda k: None if fields.get(k, "null") == "null" else int(fields[k])
    return {"fields": fields, "payload": payload, "page_id": number("WARC-Page-ID"), "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "length": length, "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}


def pieces(records: list[bytes]) -> list[bytes]:
    """A piece of every record, SAMPLE_BYTES in all at most or MIN_PIECE each: its start and then, in turn, other parts of it."""
    size = max(MIN_PIECE, SAMPLE_BYTES // max(1, len(records)))
    out = []
    for i, r in enumerate(records):
        steps = max(1, -(-(len(r) - size) // size))  # places besides the start
        at = 0 if i % 2 == 0 or len(r) <= size else min(len(r) - size, size * (1 + i // 2 % steps))
        out.append(r[at : at + size])
    return out


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from pieces of all records; the pieces themselves, an eighth of them, where there is too little to train on."""
    import zstandard as z

    some = pieces(records)
    size = sum(map(len, some))
    try:
        return z.train_dictionary(min(DICTIONARY_BYTES, size // 8), some, k=512, d=8).as_bytes()
    except z.ZstdError:
        return b"".join(r[: max(8, len(r) // 8)] for r in some)[-DICTIONARY_BYTES:]


def encode_file(records: list[bytes]) -> bytes:
    import zstandard as z

    trained = build_dictionary(records)
    packer = z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_dict_id=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(trained)), trained, *(packer.compress(r) for r in records)])


def decode_file(data: bytes) -> Iterator[bytes]:
    """The records, frame by frame."""
    import zstandard as z

    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no leading skippable frame")
    trained = data[8 : 8 + size]
    reader = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(trained) if trained else None)
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = reader.decompressobj()
        out = one.decompress(rest)
        yield out
        if not one.eof:
            raise ValueError("a record is cut short")
        rest = rest[len(rest) - len(one.unused_data) :]


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get().partitionId()
        new_name = lambda: f"{task:08d}-{seq:06d}-{uuid.uuid4().hex}.warc.zst"
        held: list[bytes] = []
        named: set[str] = set()
        size = seq = 0
        name = new_name()

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq, name
            store.create_dir(base, recursive=True)
            data = encode_file(held)
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            row = pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(held)], "n_bytes": [len(data)]})
            held, size, seq = [], 0, seq + 1
            named.clear()
            name = new_name()
            return row

        for batch in batches:
            for page_id, url, payload, digest, refers, revisit in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "refers_to", "is_revisit")), strict=True):
                body = (payload or "").encode("utf-8", "surrogatepass")
                own = response_id(digest, page_id)
                if revisit or len(body) < MIN_REVISIT or own in named:
                    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}:{len(held)}')}>"
                named.add(own)
                held.append(record(page_id, url, body, digest, refers, revisit, own, date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to and is_revisit.

    Only digests are grouped, and pre-aggregated on the way; pages meet their verdict by page id, so a payload that a
    third of all pages share makes no large group.
    """
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), body.alias("html"))
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    keys = rows.select("page_id", F.octet_length("html").alias("n"), digest.alias("digest")).filter(F.col("n") >= MIN_REVISIT)
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n_pages")).filter("n_pages > 1")
    later = keys.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()
    keyed = rows.withColumn("digest", digest)
    met = keyed.alias("a").join(later.alias("b"), F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    return met.select("a.page_id", "a.url", "a.html", "a.digest", "b.refers_to", F.col("b.digest").isNotNull().alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, date: str | None = None, **names: str) -> tuple[str, DataFrame]:
    """Writes the archives; returns their folder and the manifest: path, n_records, n_bytes. date: WARC-Date of the records, now by default."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    manifest = with_revisits(pages, **names).mapInArrow(_writer(folder, date), "path string, n_records long, n_bytes long")
    return folder, write_shared(manifest, "warc-manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                    data = f.read()
                rows: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for raw in decode_file(data):
                    x = parse_record(raw)
                    full = x["type"] == "response"
                    values = (x["page_id"], x["url"], len(x["payload"]) if full else x["length"], hashlib.sha256(x["payload"]).hexdigest() if full else x["digest"], x["type"], x["refers_to"])
                    for k, v in zip(rows, values, strict=True):
                        rows[k].append(v)
                kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in rows.items()], names=list(rows))

    return run


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of each record in the archives that the manifest lists."""
    tasks = min(20_000, max(1, manifest.count()))  # a number given keeps files apart that look small as rows
    return manifest.select("path").repartition(tasks, "path").mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
