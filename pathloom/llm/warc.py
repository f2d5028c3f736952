"""WARC archives with a two-level capture index.

Writing: each task writes one ``.warc.gz`` file, one gzip member a record, so
that any record can be read alone. Of records with equal payloads (by SHA-1) of
at least ``REVISIT_BYTES`` bytes, the one with the largest page_id is a response
and the others are revisits that refer to it, without payload.

Index: captures are range-sorted by key (``org,example,www)/path page``) and cut
into compressed blocks. Level one is a manifest, a row for each index file with
its first key; level two is the sparse directory at the end of each file, the
first key and place of each block. A lookup bisects the manifest, then the
directory, reads one block by its range, bisects it, and reads records by theirs.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import in_file, out_stream, scratch, written
from pathloom.llm.url_rules import LOWER, UPPER

REVISIT_BYTES = 1000
#: Captures of an index block.
BLOCK_LINES = 512
LEVEL = 4
#: WARC-Date of all records, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Neighbouring records are read at once up to so many bytes.
READ_BYTES = 1 << 20
#: Keys, and bytes of records, that a task is dealt.
TASK_KEYS, TASK_BYTES = 50_000, 8 << 20


def url_key(url: Column, page_id: Column) -> Column:
    """Reversed-host key of a capture; its order as bytes is that of the index. A null URL has an empty one."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")
    at = F.instr(clean, "://")
    rest = F.when(at > 0, F.substr(clean, at + 3)).otherwise(clean)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    behind = F.regexp_extract(rest, "^[^/?#]*(.*)$", 1)
    page = F.when(page_id.isNull(), "-").otherwise(F.lpad(F.regexp_replace(page_id.cast("string"), "^-", "m"), 20, "0"))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), behind, F.lit(" "), page)


def record(page: int | None, url: str, payload: bytes, digest: str, revisits: int | None, is_revisit: bool) -> bytes:
    """One WARC record, as a gzip member. ``digest``: SHA-1 of the payload in hexadecimal."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'none' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{revisits}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> dict:
    """The headers (lower-case names), HTTP headers and payload of one record; digests are verified."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
    out["payload"] = payload
    out["digest"] = base64.b32decode(out["warc-payload-digest"].partition(":")[2]).hex()
    if out["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != out["digest"]:
        raise ValueError(f"payload of {out['warc-record-id']} doesn't match its digest")
    return out


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row; returns the captures (key, file, offset, length), a written table.

    Null html is an empty payload, a null URL an empty one; rows with a null id
    never are what others refer to, and equal ids are records each. Each attempt
    of a task writes a file of its own; only those that succeeded are listed.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Who refers to whom is settled on ids and digests alone; then each payload is looked up by its own id and digest,
    # so that pages with one payload are never gathered.
    large = written(rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page", "digest"), "digests")
    shared = large.groupBy("digest").agg(F.max("page").alias("original"), F.count("*").alias("n")).where("n > 1 AND original IS NOT NULL").select("digest", "original")
    revisits = written(large.join(shared, "digest").where(~F.col("page").eqNullSafe(F.col("original"))).distinct().withColumnsRenamed({"page": "r_page", "digest": "r_digest"}), "revisits")
    typed = rows.join(revisits, (F.col("digest") == F.col("r_digest")) & F.col("page").eqNullSafe(F.col("r_page")), "left").withColumn("is_revisit", F.col("original").isNotNull())
    keyed = typed.select(url_key(F.col("url"), F.col("page")).alias("key"), "page", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"), "payload", "digest", "original", "is_revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            offsets, lengths = [], []
            for x in zip(*(batch.column(k) for k in ("page", "url", "payload", "digest", "original", "is_revisit")), strict=True):
                out = out or out_stream(uri)
                member = record(*(v.as_py() for v in x))
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([uri] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(keyed.mapInArrow(write, "key string, file string, offset long, length long"), "captures")


#: Behind the directory: its offset and size, and the mark of an index file.
DIRECTORY_END = "<QQ4s"


def build_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Sort captures into index files; returns the manifest (file, first_key, n), a written table, one row a file.

    ``captures``: key, file, offset, length; other columns are not read. Keys may
    be empty or repeat, and repeats stand in the order of file and offset. Null
    keys take no part. Without captures there is no index file.
    """
    folder = folder or scratch(captures.sparkSession, "index")
    captures = captures.where("key IS NOT NULL").select("key", "file", "offset", "length")
    ranged = captures.repartitionByRange(-(-captures.count() // TASK_KEYS) or 1, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, at, n, first, directory, held = f"{folder}/{uuid.uuid4().hex}.cdx", None, 0, 0, None, [], []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(held).encode(), 6)
            directory.append([held[0].partition("\t")[0], at, len(data)])
            out.write(data)
            at += len(data)
            held.clear()

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(k).to_pylist() for k in ("key", "file", "offset", "length")), strict=True):
                if out is None:
                    out, first = out_stream(uri), key
                held.append(f"{key}\t{file}\t{offset}\t{length}")
                n += 1
                if len(held) == BLOCK_LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data + struct.pack(DIRECTORY_END, at, len(data), b"CDX1"))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "first_key": [first], "n": pa.array([n], pa.int64())})

    return written(ranged.mapInArrow(write, "file string, first_key string, n long"), "index-manifest")


class IndexFile:
    """One index file: its sparse directory, and the block that was read last."""

    def __init__(self, uri: str) -> None:
        self.data = in_file(uri)
        tail = struct.calcsize(DIRECTORY_END)
        at, size, magic = struct.unpack(DIRECTORY_END, self.data.read_at(tail, self.data.size() - tail))
        if magic != b"CDX1":
            raise ValueError(f"not an index file: {uri}")
        self.directory = json.loads(zlib.decompress(self.data.read_at(size, at)))
        self.first = [x[0].encode() for x in self.directory]
        self.held, self.lines, self.keys = -1, [], []

    def block(self, k: int) -> None:
        if k != self.held:
            _, at, size = self.directory[k]
            self.lines = zlib.decompress(self.data.read_at(size, at)).decode().split("\n")
            self.keys = [x.partition("\t")[0].encode() for x in self.lines]
            self.held = k

    def find(self, key: bytes) -> Iterator[list[str]]:
        """All captures with the key: file, offset, length."""
        # They may begin in the block before the first that starts with the key or after it.
        k = max(0, bisect.bisect_left(self.first, key) - 1)
        while k < len(self.first) and self.first[k] <= key:
            self.block(k)
            at = bisect.bisect_left(self.keys, key)
            while at < len(self.keys) and self.keys[at] == key:
                yield self.lines[at].split("\t")[1:]
                at += 1
            k += 1


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """file, offset, length of all captures of the distinct ``key`` values.

    Keys that repeat are looked up once; null keys and those that the index lacks
    give no rows, and neither does an empty index. Other columns are not read.

    The manifest has one row for each index file, that is, for each partition of
    the job that sorted the index; these rows alone go to all tasks.
    """
    files = sorted((r["first_key"].encode(), r["file"]) for r in manifest.select("first_key", "file").collect())
    first = [k for k, _ in files]
    asked = written(keys.select("key").where("key IS NOT NULL").distinct(), "keys")
    ranged = asked.repartitionByRange(-(-asked.count() // TASK_KEYS) or 1, "key").sortWithinPartitions("key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opened = -1, None
        for batch in batches:
            found: list[list[str]] = []
            for key in batch.column("key").to_pylist():
                raw = key.encode()
                # Equal keys may run over the ends of files.
                k = max(0, bisect.bisect_left(first, raw) - 1)
                while k < len(first) and first[k] <= raw:
                    if k != at:
                        at, opened = k, IndexFile(files[k][1])
                    found += opened.find(raw)
                    k += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), *(pa.array([int(x[k]) for x in found], pa.int64()) for k in (1, 2))], ["file", "offset", "length"]
            )

    return ranged.mapInArrow(find, "file string, offset long, length long")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_records(places: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at (file, offset, length), read by ranges in the order of their place.

    Places that repeat give their record each time; an empty table gives none. The
    payload of a revisit is empty, its digest and its bytes are those of the page.
    Places are dealt to tasks by the bytes of their records.
    """
    names = [x.split()[0] for x in RECORD.split(", ")][: 7 if with_payload else 6]
    schema = RECORD if with_payload else RECORD.rpartition(", ")[0]

    def flush(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, data = "", None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            rows, held, k = [], 0, 0
            while k < len(places):
                uri, start, size = places[k]
                end, last = start + size, k + 1
                while last < len(places) and places[last][0] == uri and places[last][1] == end and end - start < READ_BYTES:
                    end += places[last][2]
                    last += 1
                if uri != opened:
                    opened, data = uri, in_file(uri)
                chunk = memoryview(data.read_at(end - start, start))
                for _, offset, length in places[k:last]:
                    r = parse(bytes(chunk[offset - start : offset - start + length]))
                    refers = r.get("warc-refers-to")
                    rows.append(
                        (page_of(r["warc-record-id"]), r["warc-target-uri"], r["warc-type"], int(r["http"]["content-length"]), r["digest"], page_of(refers) if refers else None, r["payload"])[: len(names)]
                    )
                    held += len(r["payload"]) + 200 if with_payload else 200
                k = last
                if held > 16 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    places = written(places.select("file", "offset", "length"), "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    ordered = places.repartitionByRange(-(-total // TASK_BYTES) or 1, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, schema)
