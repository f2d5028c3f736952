"""Exact merge-type (BPE) encoding by backtracking, for SentencePiece models.

A text is first cut where no merge can cross: between two characters that stand
side by side in no piece of the vocabulary. Each short segment is then encoded:

* an Aho-Corasick automaton lists the longest piece that matches at each position;
* from the left, the longest match is taken that is compatible with the piece
  before it, that is, if merging the two from single characters gives back just
  these two pieces;
* a position from which no continuation was found is marked in a bitfield and
  is never tried again.

A sequence in which all neighbours are compatible is the sequence that merging
by score would make, so the result equals the library's. The time grows with the
length of a text, spaced or not: matches are listed a window at a time.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pathloom.llm.common import Kept, per_batch

SPACE = "▁"
#: Entries of a cache before those not asked for lately go (it holds up to twice as many), and the longest key kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Characters in which matches are listed at a time.
WINDOW = 512
NEVER = -math.inf

ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
)


class MergeEncoder:
    """Encodes whole texts with the pieces and scores of one model."""

    def __init__(self, model: bytes, cache_entries: int = CACHE_ENTRIES) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, size = self.library, self.library.get_piece_size()
        self.byte_ids = [0] * 256
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[str] = [""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.pieces[piece] = i
                self.score[piece] = sp.get_score(i)
                self.text[i] = piece
        self.automaton = ahocorasick.Automaton()
        self.inner: set[str] = set()
        self.characters = {x for x in self.pieces if len(x) == 1}
        self.longest = max(map(len, self.pieces), default=1)
        for piece, i in self.pieces.items():
            self.inner.update(piece[k : k + 2] for k in range(len(piece) - 1))
            if self.merged(piece) == [piece]:  # no other piece can be in a result
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: For each piece, the longest shorter piece that it begins with.
        self.shorter: list[tuple[int, int] | None] = [None] * size
        for piece, i in self.pieces.items():
            self.shorter[i] = next((x for k in range(len(piece) - 1, 0, -1) if (x := self.automaton.get(piece[:k], None))), None)
        # No piece has a space mark after another character, so each run of marks starts a unit.
        # A line feed that is in no piece is a unit of its own.
        alone = "" if any("\n" in x for x in self.pieces) else "\n"
        self.find_units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\n" if alone else "")).findall
        #: How a piece is merged: the score of each merge, and the piece's first and last part after it.
        self.steps: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.fits = Kept(self.compatible, cache_entries)
        self.segments = Kept(self.segment, cache_entries // 4, CACHE_CHARS)
        self.units = Kept(self.unit, cache_entries, CACHE_CHARS)

    def merged(self, text: str, steps: tuple[list[float], list[str], list[str]] | None = None) -> list[str]:
        """Merge from single characters: best score first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
            if steps is not None:
                for kept, x in zip(steps, (best, parts[0], parts[-1]), strict=True):
                    kept.append(x)
        return parts

    def steps_of(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        found = self.steps.get(piece)
        if found is None:
            text = self.text[piece]
            found = self.steps[piece] = [], [text[0]], [text[-1]]
            self.merged(text, found)
            found[0].append(NEVER)
        return found

    def compatible(self, pair: int) -> bool:
        """Whether merging the characters of both pieces (left << 20 | right) gives back just the two.

        Each piece alone merges as it always does. The merges of the two are gone
        through again in the order of their scores, and between them a merge over
        the seam is looked for: of its last part on the left and first on the right.
        """
        ours, _, lasts = self.steps_of(pair >> 20)
        theirs, firsts, _ = self.steps_of(pair & 0xFFFFF)
        i = j = 0
        score = self.score.get
        while True:
            a, b, seam = ours[i], theirs[j], score(lasts[i] + firsts[j], NEVER)
            if seam > a and seam >= b and seam > NEVER:  # of equals the leftmost goes first
                return False
            if a >= b:
                if a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def backtrack(self, text: str) -> list[int]:
        """Encode a segment all of whose characters are pieces."""
        n = len(text)
        fits, shorter, longest = self.fits, self.shorter, self.automaton.iter_long
        failed = None  # bitfield of positions from which no continuation was found
        ids: list[int] = []
        sizes: list[int] = []
        last, pos = -1, 0
        # The list of matches goes on from the end of the last one; those that begin after ``sure`` might be cut off.
        ahead, sure = longest(text[:WINDOW]), n if n <= WINDOW else WINDOW - self.longest
        match = first = None
        for _, match in ahead:  # mostly the longest matches fit one another as they are
            i, size = first = match
            if pos > sure or last >= 0 and not fits[last << 20 | i]:
                break
            ids.append(i)
            sizes.append(size)
            last = i
            pos += size
        if pos == n:
            return ids
        if pos > sure:
            ahead = longest(text[pos : pos + WINDOW])
            sure = n if n - pos <= WINDOW else pos + WINDOW - self.longest
            match = first = next(ahead)[1]
        while True:
            while match is not None:
                i, size = match
                end = pos + size
                if (failed is None or not failed[end >> 3] >> (end & 7) & 1) and (last < 0 or fits[last << 20 | i]):
                    break
                match = shorter[i]
            if match is not None:
                ids.append(i)
                sizes.append(size)
                last, pos = i, end
                if pos == n:
                    return ids
                if match is not first or pos > sure:
                    ahead = longest(text[pos : pos + WINDOW])
                    sure = n if n - pos <= WINDOW else pos + WINDOW - self.longest
                match = first = next(ahead)[1]
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                if not ids:
                    raise ValueError(f"no encoding for {text!r}")
                match, first = shorter[ids.pop()], None
                pos -= sizes.pop()
                last = ids[-1] if ids else -1

    def segment(self, text: str) -> str:
        """Ids of a segment, joined by commas: texts, unlike lists, cost the garbage collector nothing."""
        if len(text) > 1 or text in self.pieces:
            return ",".join(map(str, self.backtrack(text)))
        return ",".join([str(self.byte_ids[b]) for b in text.encode()])

    def unit(self, text: str) -> str:
        """Ids of one unit, a run of space marks and what follows it, joined by commas."""
        if len(text) <= CACHE_CHARS and self.characters.issuperset(text):
            return self.segment(text)
        inner, found, start = self.inner, [], 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in inner:
                found.append(self.segments[text[start:k]])
                start = k
        found.append(self.segments[text[start:]])
        return ",".join(found)

    def listed(self, text: str | None) -> str:
        """The ids of a text, joined by commas."""
        if not text:
            return ""
        return ",".join([*map(self.units.__getitem__, self.find_units(SPACE + text.replace(" ", SPACE)))])

    def encode(self, text: str | None) -> list[int]:
        return ids_of(self.listed(text))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


def ids_of(listed: str) -> list[int]:
    return np.fromstring(listed, np.int32, sep=",").tolist() if listed else []


_ENCODERS: dict[bytes, MergeEncoder] = {}


def encoder_of(model: bytes) -> MergeEncoder:
    """One encoder for all tasks that a Python worker runs: its caches stay warm."""
    key = hashlib.sha256(model).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = MergeEncoder(model)
        gc.freeze()  # what is there by now stays: it need not be gone through again
    return _ENCODERS[key]


def encode_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each row's whole text; returns ``id_col`` (as it is), n_tokens, ids, decoded.

    A null or empty text has no ids and decodes to the empty text. Ids may be
    null or repeat: rows stay apart. Other columns are not read, so their names
    don't matter. An empty table gives an empty table.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def make():
        encoder = encoder_of(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encoder.encode(x.as_py()) for x in batch.column("text")]
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.string())],
                [id_col, *ENCODED.names],
            )

        return work

    return per_batch(rows, make, T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *ENCODED]))


def digest_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with SHA-256 digests of the ids and of the decoded text."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def make():
        encoder = encoder_of(model)

        def one(text: str | None) -> tuple[int, str, str]:
            listed = encoder.listed(text)
            ids = ids_of(listed)
            decoded = encoder.decode(ids)
            return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = zip(*(one(x.as_py()) for x in batch.column("text")), strict=True) if batch.num_rows else ((), (), ())
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema.names)

        return work

    return per_batch(rows, make, schema)
