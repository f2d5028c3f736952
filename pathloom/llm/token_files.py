"""Token files: ids in patched frame-of-reference blocks, in ascending order of documents.

One file holds the ids of a range of documents, one document after another:

    magic "PLT1"
    blocks             of BLOCK ids each, the last one shorter
    block starts       byte offset of each block, uint64
    documents          int64 id, uint8 1 if the id is null, uint64 number of ids
    footer             uint64 offset of block starts, uint64 number of blocks,
                       uint64 number of documents, uint64 number of ids, magic

and a block holds

    uint32 minimum, uint8 width, uint8 zero, uint16 count, uint16 exceptions
    exceptions         uint16 positions, then uint32 values (what the width leaves over)
    packed             count values of ``width`` bits, value minus minimum, low bits first

``width`` is the number of bits that ``PERCENTILE`` of the block's values need;
the rest are exceptions. Any block can be read alone through the block starts.
"""

from __future__ import annotations

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
from pyspark.sql import types as T

from pathloom.llm.common import Kept, in_file, out_stream, scratch, written

MAGIC = b"PLT1"
BLOCK = 4096
PERCENTILE = 90
FOOTER = struct.Struct("<QQQQ4s")
HEAD = struct.Struct("<IBBHH")
DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
#: Bytes that a reader asks for at a time.
READ_BYTES = 1 << 20


def pack_block(values: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block of at most 65,535 ids (uint32)."""
    low = int(values.min()) if len(values) else 0
    rest = (values - np.uint32(low)).astype(np.uint32)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length() if len(rest) else 0
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    head = HEAD.pack(low, width, 0, len(rest), len(over))
    patches = over.astype("<u2").tobytes() + (rest[over] >> np.uint32(width)).astype("<u4").tobytes() if len(over) else b""
    if not width:
        return head + patches
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=None)[:, :width]
    return head + patches + np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    low, width, _, count, n_over = HEAD.unpack_from(data)
    at = HEAD.size
    over = np.frombuffer(data, "<u2", n_over, at).astype(np.int64)
    high = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    at += 6 * n_over
    if width:  # each value lies in the few bytes from that of its first bit on
        raw = np.zeros((count * width + 7) // 8 + 5, np.uint64)
        raw[:-5] = np.frombuffer(data, np.uint8, len(raw) - 5, at)
        bit = np.arange(count, dtype=np.uint64) * np.uint64(width)
        first = (bit >> np.uint64(3)).astype(np.int64)
        wide = raw[first]
        for k in range(1, (width + 14) // 8):
            wide |= raw[first + k] << np.uint64(8 * k)
        rest = ((wide >> (bit & np.uint64(7))) & np.uint64((1 << width) - 1)).astype(np.uint32)
    else:
        rest = np.zeros(count, np.uint32)
    if n_over:
        rest[over] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return rest + np.uint32(low)


class TokenFileWriter:
    """Streams documents into one file; holds one open block and the indexes."""

    def __init__(self, uri: str) -> None:
        self.uri, self.out = uri, out_stream(uri)
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.total = len(MAGIC), [], [], 0
        self.open: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.total += len(ids)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.open)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(ids[k : k + BLOCK])
            self.open, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.starts.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.open))
        docs = np.array(self.docs, DOC)
        self.out.write(np.array(self.starts, "<u8").tobytes() + docs.tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.starts), len(docs), self.total, MAGIC))
        self.out.close()


class TokenFile:
    """Reads a token file by ranges."""

    def __init__(self, uri: str) -> None:
        self.data = in_file(uri)
        end = self.data.size() - FOOTER.size
        self.ends_at, n_blocks, n_docs, self.total, magic = FOOTER.unpack(self.data.read_at(FOOTER.size, end))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        index = self.data.read_at(end - self.ends_at, self.ends_at)
        self.starts = np.append(np.frombuffer(index, "<u8", n_blocks), np.uint64(self.ends_at)).astype(np.int64)
        self.docs = np.frombuffer(index, DOC, n_docs, 8 * n_blocks)

    def block(self, k: int) -> np.ndarray:
        return unpack_block(self.data.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k])))

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file: only their blocks are read."""
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * BLOCK :][:n]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; holds about one document and READ_BYTES."""
        k, held = 0, np.empty(0, np.uint32)
        for doc in self.docs:
            n = int(doc["n"])
            if len(held) < n:
                more, have = [held], len(held)
                while have < n:
                    end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + READ_BYTES, "right")) - 1)
                    base = int(self.starts[k])
                    data = memoryview(self.data.read_at(int(self.starts[end]) - base, base))
                    for b in range(k, end):
                        more.append(unpack_block(data[int(self.starts[b]) - base : int(self.starts[b + 1]) - base]))
                        have += len(more[-1])
                    k = end
                held = np.concatenate(more)
            yield None if doc["null"] else int(doc["id"]), held[:n]
            held = held[n:]


#: ASCII characters that the word tokenizer never joins to a letter before them. The apostrophe is not among them.
ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Bytes of the longest word whose ids are kept.
LONGEST = 64


class WordEncoder:
    """Ids of the tokenizers library, kept for words that were met before.

    A text is cut on ASCII white space, which this tokenizer drops and never
    crosses. Letters below U+0250 and ASCII marks behind them are two words to
    the tokenizer; each is kept apart and goes straight to the library's model.
    All other words pass through the whole library.
    """

    def __init__(self, definition: str, cache_entries: int = 200_000) -> None:
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(definition)
        self.tokenize = self.library.model.tokenize
        to_bytes = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: What the model calls the bytes of letters beyond ASCII.
        self.names = {k: to_bytes.pre_tokenize_str(chr(k))[0][0] for k in range(0xA0, 0x250)}
        self.words = Kept(self.word, cache_entries, LONGEST)
        self.parts = Kept(self.part, cache_entries // 2, LONGEST)

    def asked(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of what is one word to the tokenizer, in lower case."""
        named = text if text.isascii() else text.translate(self.names)
        return array("I", [x.id for x in self.tokenize(named)]).tobytes()

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        stem = text.rstrip(ENDS)
        if not stem:
            return self.parts[text] if text else b""
        low = stem.lower()
        # Some letters below U+0250 have small forms beyond it.
        if not stem.isalpha() or not (stem.isascii() or max(stem) < "ɐ" > max(low) and len(low) == len(stem)):
            return self.asked(text)
        return self.parts[low] + self.parts[text[len(stem) :]] if len(stem) < len(text) else self.parts[low]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text; none if it is null. Each distinct word of the texts is looked up once."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded, bounds = split.values.dictionary_encode(), split.offsets.to_numpy()
        found = [*map(self.words.__getitem__, coded.dictionary.cast(pa.large_binary()).to_pylist())]
        codes, ids = coded.indices.to_numpy(), np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        for a, b in zip(bounds, bounds[1:], strict=False):
            n = sizes[codes[a:b]]
            behind = np.cumsum(n)
            yield ids[np.repeat(starts[codes[a:b]] - behind + n, n) + np.arange(n.sum())]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(definition: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = WordEncoder(definition)
    return _ENCODERS[definition]


MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
    ]
)


def write_token_files(
    df: DataFrame, definition: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts and write token files; returns the manifest (a written table).

    Documents are range-partitioned and sorted by ``id_col`` before they are
    encoded, so that ids are written where they are made. Each attempt of a task
    writes files of its own, and only those of attempts that succeeded are in
    the manifest. A null or empty text is a document of ``end_id`` alone. Null
    ids come first, equal ids in the order of their texts. An empty table gives
    an empty manifest.
    """
    folder = folder or scratch(df.sparkSession, "tokens")
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer, first = encoder_of(definition), np.array([end_id], "<u4"), None, None
        for batch in batches:
            for doc_id, ids in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                if writer is None:
                    writer, first = TokenFileWriter(f"{folder}/{uuid.uuid4().hex}.plt"), doc_id
                writer.add(doc_id, np.append(ids, end))
            pa.default_memory_pool().release_unused()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [writer.uri], "first_id": pa.array([first], pa.int64()), "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    return written(ranged.mapInArrow(write, MANIFEST), "manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids of all files before. One row a file, so one window is enough."""
    before = W.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.list_(pa.int64())) for k, c in enumerate(columns)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, ids in TokenFile(uri).documents():
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((doc_id, start, len(ids), crc, *([ids.tolist()] * with_ids)))
                    start += len(ids)
                    held += len(ids) if with_ids else 1
                    if held >= 200_000:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = file_starts(manifest).select("file", "start")
    return files.repartition(max(1, manifest.count())).mapInArrow(read, schema)
