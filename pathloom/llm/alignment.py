"""How the tokens of two tokenizers lie over one another in the same bytes.

Tokenizer A (byte level) reads a space and the text; B (pieces) reads the text and
adds the space itself. If the tokens of both spell the same bytes, each byte gets a
label: ``n`` if no token ends there, ``a`` or ``b`` if one of A or B does, ``x`` if
both do. A regular expression cuts the label string behind each ``x``; the labels of
such a span say how many tokens of A and of B form the group. Tokens that overlap
are linked, within a group alone.

A text is cut at single spaces and line ends between letters, which no token of
either tokenizer crosses, so a word with the space before it is aligned once and its
alignment is kept. The words of a text that are new are read together.

For each pair of ids a table counts the documents that hold it linked. Scores of
documents look pairs up there: the most frequent ``HOT`` pairs travel to all tasks,
the others, none of which is in very many documents, are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import per_batch, written

#: Pairs of ids whose counts travel to all tasks.
HOT = 1 << 16
#: Words whose alignments a task keeps, and the letters of the longest of them.
WORDS, LONGEST = 200_000, 32
SPAN = re.compile("[nab]*x")
#: Single spaces and line ends that neither tokenizer's words cross: marks and letters up to U+024F on both sides.
CUT = re.compile("(?<=[!-~À-ɏ])(?=[ \\n][!-~À-ɏ])")
SPACE = "▁"
ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: bytes that can be printed are themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Tokens, spans and links of texts under two tokenizers: a definition (JSON) of A and a model of B."""

    def __init__(self, definition: str, model: bytes) -> None:
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_of()
        n = self.b.get_piece_size()
        self.a_bytes = [bytes(letters[c] for c in t) if t and all(c in letters for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        #: Pieces end at spaces and lines, so words may be taken one by one.
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in map(self.b.id_to_piece, range(n)))
        self.names = [*map(str, range(max(n, len(self.a_bytes))))]
        #: Alignments of words; when ``kept`` is full, those not asked for lately go.
        self.kept: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def fresh(self, units: list[str]) -> list[tuple] | None:
        """What ``known`` keeps of each unit, read in one go as the text that they make together; None if tokens spell something else."""
        if not units[0].startswith(" "):  # a text begins with a space
            more = self.fresh([" -", *units])
            return more and more[1:]
        text = "".join(units)
        own = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        spelled = [[*map(table.__getitem__, ids)] for table, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        if b"".join(spelled[0]) != own or b"".join(spelled[1]) != own:
            return None
        a_size, b_size = ([*map(len, x)] for x in spelled)
        a_ends, b_ends = np.cumsum(a_size) - 1, np.cumsum(b_size) - 1
        labels = np.full(len(own), ord("n"), np.uint8)
        labels[a_ends] = ord("a")
        labels[b_ends] = np.where(labels[b_ends] == ord("a"), ord("x"), ord("b"))
        out = []
        sizes = iter(map(len, units) if text.isascii() else (len(u.encode()) for u in units))
        i = j = at = first_a = first_b = 0
        end = next(sizes)
        groups, links = [], []
        name = self.names
        for span in SPAN.findall(labels.tobytes().decode()):
            i2, j2 = i + span.count("a") + 1, j + span.count("b") + 1  # x ends one of both
            if i2 - i == 1 == j2 - j:
                groups.append(f"{name[a[i]]}|{name[b[j]]}")
                links.append(a[i] << 32 | b[j])
            elif i2 - i == 1 or j2 - j == 1:
                groups.append(f"{','.join([name[x] for x in a[i:i2]])}|{','.join([name[y] for y in b[j:j2]])}")
                links += [x << 32 | y for x in a[i:i2] for y in b[j:j2]]
            else:
                groups.append(f"{','.join([name[x] for x in a[i:i2]])}|{','.join([name[y] for y in b[j:j2]])}")
                # Two orders of the same bytes: the token that ends first makes way for the next of its own.
                x, y, of_a, of_b = i, j, a_size[i], b_size[j]
                while True:
                    links.append((a[x] << 32) | b[y])
                    if x == i2 - 1 and y == j2 - 1:
                        break
                    if of_a < of_b:
                        x += 1
                        of_a += a_size[x]
                    else:
                        y += 1
                        of_b += b_size[y]
            i, j = i2, j2
            at += len(span)
            if at == end:  # units end where both end
                out.append((i - first_a, j - first_b, len(groups), ";".join(groups), links))
                first_a, first_b = i, j
                end += next(sizes, 0)
                groups, links = [], []
        return out

    def known(self, units: Iterable[str]) -> dict[str, tuple] | None:
        """n_a, n_b, n_groups, groups as text and linked pairs of each unit, in the order of a text; those of short units are kept."""
        found, missing = {}, []
        for u in units:
            x = self.kept.get(u) or self.older.get(u)
            if x is None:
                missing.append(u)
            else:
                found[u] = x
        if missing:
            fresh = self.fresh(missing)
            if fresh is None:
                return None
            if len(self.kept) >= WORDS:
                self.kept, self.older = {}, self.kept
            for u, x in zip(missing, fresh, strict=True):
                found[u] = x
                if len(u) <= LONGEST:
                    self.kept[u] = x
        return found

    def document(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, SHA-256 of the groups ('' without tokens), distinct linked pairs (A's id in the high 32 bits) and how often."""
        none = 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        units = CUT.split(" " + text) if self.by_words else [" " + text]
        often = Counter(units)
        made = self.known(often)
        if made is None:
            return none
        digest = hashlib.sha256()
        for k in range(0, len(units), 4096):
            digest.update((";" * bool(k) + ";".join([made[u][3] for u in units[k : k + 4096]])).encode())
        each = [(made[u], n) for u, n in often.items()]
        n_a, n_b, n_groups = (sum([n * x[c] for x, n in each]) for c in range(3))
        sizes = [len(x[4]) for x, _ in each]
        flat = np.fromiter(chain.from_iterable([x[4] for x, _ in each]), np.int64, sum(sizes))
        pairs, place = np.unique(flat, return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, place, np.repeat([n for _, n in each], sizes))
        return n_a, n_b, n_groups, int(times.sum()), digest.hexdigest(), pairs, times


#: The aligner of this process, by its definition and model: tasks that follow one another in a process share what is kept.
_own: dict[tuple[int, int], Aligner] = {}


def aligner(definition: str, model: bytes) -> Aligner:
    key = hash(definition), hash(model)
    if key not in _own:
        _own.clear()
        _own[key] = Aligner(definition, model)
    return _own[key]


def aligned(rows: DataFrame, definition: str, model: bytes) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and times of distinct linked pairs, of (row, doc_id, text) rows."""

    def make():
        own = aligner(definition, model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.document(x.as_py()) for x in batch.column("text")]
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else ((),) * 7, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *made], [c.split()[0] for c in ROW.split(", ")])

        return work

    return per_batch(rows, make, ROW)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, a, b, count (documents that hold the pair linked) and best (no pair of the same a has a higher count)."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    a = F.shiftright("pair", 32).alias("a")
    top = counts.groupBy(a).agg(F.max("count").alias("top"))
    named = counts.select("pair", a, F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count")
    return named.join(top, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best and count_sum of each row of ``aligned``: links whose pair is its A id's best, and the counts of all links."""
    hot = counts.orderBy(F.desc("count"), "pair").limit(HOT).select("pair", "count", "best").toPandas().sort_values("pair")  # HOT rows
    known, count, best = hot["pair"].to_numpy(np.int64), hot["count"].to_numpy(np.int64), hot["best"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            ends, flat = np.append(0, np.cumsum(pairs.value_lengths().to_numpy())), pairs.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            sums = []
            for values in (best, count):
                worth = np.append(0, np.cumsum(np.where(hit, values[at] if len(known) else 0, 0) * times))
                sums.append(worth[ends[1:]] - worth[ends[:-1]])
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(ends))[~hit]
            cut = np.append(0, np.cumsum(np.bincount(of_row, minlength=batch.num_rows))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v[~hit], k)) for v, k in ((flat, pa.int64()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums), *rest], ["row", "n_best", "count_sum", "pairs", "times"])

    near = found.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    near = written(near, "hot-links")
    links = near.where(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair", "times": "n"})
    far = links.join(counts, "pair").select("row", (F.col("n") * F.col("best").cast("long")).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    return near.select("row", "n_best", "count_sum").unionByName(far).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(df: DataFrame, definition: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row; and ``pair_counts`` of all rows.

    ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``: ids of A and B of each group, in
    order. Texts that are null or empty, or whose tokens spell other bytes than a
    space and the text, have no tokens: zeros, and '' as hash. Each row counts as a
    document, also where ids repeat or are null. Only the two columns are read. An
    empty table gives empty tables.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    found = written(aligned(rows, definition, model), "aligned")
    counts = written(pair_counts(found), "pairs")
    out = found.drop("pairs", "times").join(scored(found, counts), "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts


def likely_translations(counts: DataFrame, least: int = 1) -> DataFrame:
    """a, b and count: the ids of B that each id of A is linked to in most documents, at least ``least``; ties all."""
    return counts.where(F.col("best") & (F.col("count") >= least)).select("a", "b", "count")


def ranked_pairs(counts: DataFrame, k: int) -> DataFrame:
    """a, rank, b and count: of each id of A the k ids of B that it is linked to in most documents, ties to the smaller id."""
    order: Column = F.row_number().over(W.partitionBy("a").orderBy(F.desc("count"), "b"))
    return counts.withColumn("rank", order).where(F.col("rank") <= k).select("a", "rank", "b", "count")
