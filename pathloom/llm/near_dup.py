"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped edges.

A document's set holds its distinct shingles (runs of ``SHINGLE`` words). Two
documents are linked if the Jaccard similarity of their sets is at least
``NUMERATOR / DENOMINATOR``; a component is what links reach.

1. One pass over the texts gives each set's 128-bit fingerprint and its sketch:
   one permutation splits the hashes into BINS bins, each keeps its smallest,
   and an empty bin borrows from a full one chosen by a fixed random order
   (optimal densification). Equal sets collapse into one node here.
2. BANDS bands of ROWS bins make buckets. In each bucket all members get an edge
   to one centre, so edges number members, not pairs. The centre is the member
   that shares most buckets with others.
3. An edge whose sketches differ in more than MOST_UNLIKE bins is dropped; the
   rest are confirmed on the full sets, made again from the texts of those nodes
   alone.
4. Links make components. A bucket that still has several components may hide a
   link between two non-centres. Its members outside its largest component are
   held against all its members of other components by both sketches, and what is
   alike enough is confirmed on full sets. Pairs within a component are never
   compared, and no bucket is capped.

A pair at the threshold shares no bucket with probability
(1 - 0.8 ** ROWS) ** BANDS, under 3e-6 with the values here; the sketches are held
to limits five deviations out or more. With ``exact``, sketches rule out nothing in
step 4: nodes of open buckets go through an exact join instead. Linked sets share
a shingle among the first few of each in a common order, rare ones first, and all
pairs of different components that do are confirmed. It makes more pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import per_batch, written

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
ROWS, BANDS = 5, 32
BINS = ROWS * BANDS
#: Of BINS lanes of four bits; at similarity 0.8 the mean is 30 and the deviation 4.9.
MOST_UNLIKE = 60
CACHE_ENTRIES = 150_000
#: The finer sketch that pairs outside stars are held against: mean 192, deviation 12.5 at the threshold.
FINE_BINS, FINE_UNLIKE = 1024, 267
#: Pairs of a node that are dealt to one key.
SALT_PAIRS = 64
#: Hash classes whose counts tell rare shingles; the table of counts has so many numbers whatever the data.
CLASSES = 1 << 17

_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


@cache
def _bins(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of n bins starts, and for each bin the place of each other in the order in which it asks them."""
    starts = np.array([-((-k << 64) // n) for k in range(n)], np.uint64)
    return starts, np.random.default_rng(n).random((n, n)).argsort(axis=1).argsort(axis=1).astype(np.int16)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = (text or "").encode().lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([*map(hashes.__getitem__, words)], np.uint64)
    if len(h) < size:  # the whole sequence is one shingle
        size = len(h)
        h = h ^ _MIX[15 - size % 8]
    n = len(h) - size + 1
    out = np.full(n, 0x243F6A8885A308D3, np.uint64)
    for k in range(size):
        out = _mixed(out + h[k : k + n] * _MIX[k])
    return np.unique(out)


def sketch(hashes: np.ndarray, n: int = BINS) -> np.ndarray:
    """The smallest hash of each of n bins (uint64), densified. ``hashes``: sorted, not empty."""
    starts, order = _bins(n)
    at = np.searchsorted(hashes, starts)
    full = at < np.append(at[1:], len(hashes))
    low = hashes[np.minimum(at, len(hashes) - 1)]
    if full.all():
        return low
    have, lack = np.flatnonzero(full), np.flatnonzero(~full)
    low[lack] = low[have[order[np.ix_(lack, have)].argmin(axis=1)]]
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        out = _mixed(out ^ rows[:, k])
    return out.view(np.int64)


def lanes_of(low: np.ndarray) -> np.ndarray:
    """Four bits of each bin, in BINS / 16 longs."""
    four = (_mixed(low) >> np.uint64(60)).reshape(-1, 16)
    out = np.zeros(len(four), np.uint64)
    for k in range(16):
        out |= four[:, k] << np.uint64(4 * k)
    return out.view(np.int64)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, print (fingerprint of the set; null if empty), n_shingles, bands and lanes of (doc_id, text) rows."""

    def make():
        hashes = _Hashes()

        def one(text):
            found = shingle_set(text, size, hashes)
            if not len(found):
                return None, 0, None, None
            low = sketch(found)
            return xxhash.xxh3_128_digest(found.tobytes()), len(found), bands_of(low), lanes_of(low)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints, n, bands, lanes = zip(*(one(x.as_py()) for x in batch.column("text")), strict=True) if batch.num_rows else ((),) * 4
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, longs), pa.array(lanes, longs)],
                ["doc_id", "print", "n_shingles", "bands", "lanes"],
            )

        return work

    return per_batch(rows, make, "doc_id long, print binary, n_shingles long, bands array<long>, lanes array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """node, doc, its full set and the lanes of its finer sketch, of (node, doc, print, text) rows.

    Rows whose text has another fingerprint are left out.
    """

    def make():
        hashes = _Hashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, docs, sets = [], [], []
            for node, doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("node", "doc", "print", "text")), strict=True):
                found = shingle_set(text, size, hashes)
                if xxhash.xxh3_128_digest(found.tobytes()) == mark:
                    nodes.append(node)
                    docs.append(doc)
                    sets.append(found.view(np.int64))
            fine = [lanes_of(sketch(x.view(np.uint64), FINE_BINS)) for x in sets]
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(docs, pa.int64()), pa.array(sets, longs), pa.array(fine, longs)], ["node", "doc", "shingles", "fine"])

        return work

    return per_batch(rows, make, "node long, doc long, shingles array<long>, fine array<long>")


def _unlike_lanes(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    for shift in (1, 2):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def unlike(a: Column, b: Column) -> Column:
    """Number of lanes in which two sketches of BINS bins differ."""
    return sum((_unlike_lanes(a[k], b[k]) for k in range(1, BINS // 16)), _unlike_lanes(a[0], b[0]))


def unlike_fine(a: Column, b: Column) -> Column:
    """The same for finer sketches, as a fold: so long an expression would not compile."""
    return F.aggregate(F.zip_with(a, b, _unlike_lanes), F.lit(0), lambda n, x: n + x)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and their docs, of those (a, b) pairs of nodes whose full sets are similar enough.

    ``pairs`` has ``salts``, the number of keys over which the pairs of ``a`` are
    dealt, so that a node with many pairs isn't one task's work. Of each pair the
    set of ``b`` travels, and that of ``a`` once a salt.
    """
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")
    theirs = pairs.select("a", "b", salt).join(sets.select(F.col("node").alias("b"), F.col("doc").alias("doc_b"), F.col("shingles").alias("of_b")), "b")
    wanted = pairs.groupBy("a").agg(F.max("salts").alias("salts"))
    ours = sets.select(F.col("node").alias("a"), F.col("doc").alias("doc_a"), F.col("shingles").alias("of_a")).join(wanted, "a").select("a", "doc_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "of_a")
    both = theirs.join(ours, ["a", "salt"]).select("a", "b", "doc_a", "doc_b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return both.where(DENOMINATOR * F.col("common") >= NUMERATOR * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b", "doc_a", "doc_b")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that links reach, of all nodes in (a, b) links.

    In each round a node takes the smallest label around it and then the label
    of the node so named (pointer jumping). Rounds are written tables; their
    number grows with the logarithm of a component's breadth. What a node with
    many links sends is a few numbers a link, and Spark splits such a join's key.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "round")
    while True:
        around = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = state.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("via"))
        names = state.select(F.col("node").alias("via"), F.col("label").alias("onward"))
        step = nearer.join(names, "via").select("node", F.col("onward").alias("label"), (F.col("onward") != F.col("was")).alias("moved"))
        state = written(step, "round")
        if state.where("moved").isEmpty():
            return state.select("node", "label")
        state = state.select("node", "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document has its component's smallest id) of every row.

    A null or empty text has an empty set, is linked with nothing and is kept.
    Rows of the same id are one document, whether their texts are equal or not:
    it is linked as any of its texts is. A row with a null id can't be named: it
    links nothing, its component_id is null and it is kept. Only the two columns
    are read, so other names don't matter. An empty table gives an empty table.
    """
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    signed = written(signatures(rows, shingle), "signatures")
    usable = signed.where("print IS NOT NULL AND doc_id IS NOT NULL")
    # Documents with equal sets are one node; ``doc`` is the smallest id among them.
    same = usable.groupBy("print").agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "lanes")))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = _labels(nodes, usable, rows, shingle, exact)
    named = nodes.join(labels, "doc", "left").select("print", F.coalesce("label", "doc").alias("label"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return signed.select("doc_id", "n_shingles", "print").join(named, "print", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _labels(nodes: DataFrame, usable: DataFrame, rows: DataFrame, size: int, exact: bool) -> DataFrame:
    """doc and label of the documents (smallest ids of nodes) that are linked."""
    # Ids that repeat. Where their texts differ, the document ties the nodes that they are in.
    repeated = written(usable.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("print").alias("low"), F.max("print").alias("high")).where("n > 1"), "repeated")
    several = not repeated.isEmpty()
    ties = usable.join(repeated.where("low != high").select("doc_id"), "doc_id").join(nodes.select("print", "doc"), "print").where("doc_id != doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))

    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowded = written(members.join(shared, "bucket"), "buckets")  # most buckets hold one node and end here
    rank = crowded.groupBy("node").agg(F.sum("size").alias("rank"), F.max("size").alias("most"))
    traits = written(nodes.join(rank, "node").select("node", "doc", "print", "n_shingles", "bands", "lanes", "rank", "most"), "traits")
    texts = rows.join(traits.select("doc", "node", "print"), F.col("doc_id") == F.col("doc")).select("node", "doc", "print", "text")
    sets = shingle_sets(texts, size)
    sets = written(sets.dropDuplicates(["node"]) if several else sets, "sets")

    # Star-shaped edges: from the bucket's centre to each other member.
    named = traits.select("node", F.struct("rank", -F.col("node"), "most").alias("place"))
    centres = crowded.join(named, "node").groupBy("bucket").agg(F.max("place").alias("c")).select("bucket", (-F.col("c.col2")).alias("centre"), F.col("c.most").alias("most"))
    star = crowded.join(centres, "bucket").where("node != centre").groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(F.max("most").alias("most"))
    salted = star.withColumn("salts", F.ceil(F.col("most") / SALT_PAIRS).cast("long")).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    of_a = traits.select(F.col("node").alias("a"), F.col("lanes").alias("lanes_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("most") / SALT_PAIRS).cast("long") - 1)).alias("salt"))
    of_b = traits.select(F.col("node").alias("b"), F.col("lanes").alias("lanes_b"))
    likely = written(salted.join(of_b, "b").join(of_a, ["a", "salt"]).where(unlike(F.col("lanes_a"), F.col("lanes_b")) <= MOST_UNLIKE).select("a", "b", "salts"), "likely")
    links = confirmed(likely, sets).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    parts = components(links.where("a != b").union(ties)).withColumnsRenamed({"node": "doc", "label": "part"})

    # Buckets that still hold several components.
    placed = written(traits.join(parts, "doc", "left").select("node", "n_shingles", F.coalesce("part", "doc").alias("part")), "placed")
    inside = crowded.select("bucket", "node").join(placed, "node")
    pairs = prefix_pairs(inside, sets) if exact else alike_pairs(inside, traits, sets)
    more = written(confirmed(written(pairs, "pairs"), sets), "more-links")
    part_of = [placed.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab"]
    between = more.join(part_of[0], "a").join(part_of[1], "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    joined = components(between)
    relabelled = parts.join(joined.withColumnRenamed("node", "part"), "part", "left").select("doc", F.coalesce("label", "part").alias("label"))
    alone = joined.withColumnRenamed("node", "doc").join(parts.select("doc"), "doc", "left_anti")
    return written(relabelled.unionByName(alone), "labels")


def alike_pairs(inside: DataFrame, traits: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, salts) of nodes of different parts in a bucket (bucket, node, part) that both sketches find alike.

    Members outside a bucket's largest part meet all members of other parts; the
    sketches are looked at where they meet, so only alike pairs come out.
    """
    sizes = inside.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("members")).where("parts > 1")
    open_ = open_.select("bucket", "main", F.ceil(F.col("members") / SALT_PAIRS).cast("long").alias("salts"))
    earlier = F.slice("bands", 1, F.array_position("bands", F.col("bucket")).cast("int") - 1).alias("earlier")
    left = inside.join(open_, "bucket").join(traits.select("node", "bands", "lanes"), "node").join(sets.select("node", "fine"), "node")
    left = written(left.select("bucket", "main", "salts", "part", "node", "lanes", "fine", earlier), "open")
    a, b = left.where("part != main").alias("a"), left.alias("b")
    other = (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    near = unlike(F.col("a.lanes"), F.col("b.lanes")) <= MOST_UNLIKE
    first = ~F.arrays_overlap("a.earlier", "b.earlier")  # a pair comes up in the first bucket that it shares
    nearer = unlike_fine(F.col("a.fine"), F.col("b.fine")) <= FINE_UNLIKE
    rest = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & other & near & first & nearer)
    return rest.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.max("a.salts").alias("salts"))


def salted(pairs: DataFrame) -> DataFrame:
    """(a, b, salts) of pairs: ``a`` is the node that has more of them, and they are dealt over salts."""
    pairs = written(pairs, "candidates")
    degree = pairs.select(F.col("a").alias("x")).union(pairs.select("b")).groupBy("x").agg(F.count("*").alias("degree"))
    both = pairs.join(degree.withColumnsRenamed({"x": "a", "degree": "d_a"}), "a").join(degree.withColumnsRenamed({"x": "b", "degree": "d_b"}), "b")
    more = F.col("d_a") >= F.col("d_b")
    return both.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("b"), F.ceil(F.greatest("d_a", "d_b") / SALT_PAIRS).cast("long").alias("salts"))


def prefix_pairs(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, salts) of nodes of different parts, in open buckets, that may be linked; none that is linked is missing.

    ``inside``: bucket, node, part, n_shingles. All sets are put in one order, rare
    shingles first as far as counts of hash classes tell. Sets of n and of fewer
    shingles that are linked share one of the first n - least + 1 of each, where
    ``least`` is the smallest overlap that a link needs; and their sizes are alike.
    """
    open_ = inside.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("bucket")
    nodes = inside.join(open_, "bucket").select("node", "part", "n_shingles").distinct()
    counted = sets.mapInArrow(_class_counts, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    often = np.zeros(CLASSES, np.int64)
    for k, n in counted.collect():  # at most CLASSES rows
        often[k] = n

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            shingles = batch.column("shingles")
            ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            first = []
            for a, b in zip(ends, ends[1:], strict=False):
                own = flat[a:b]
                n = len(own)
                keep = n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1
                first.append(own[np.lexsort((own, often[own & (CLASSES - 1)]))[:keep]])
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(first, pa.list_(pa.int64()))], ["node", "first"])

        return work

    first = per_batch(sets, make, "node long, first array<long>")
    heads = written(first.join(nodes, "node").select("node", "part", F.col("n_shingles").alias("n"), F.explode("first").alias("shingle")), "prefixes")
    mixed = heads.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("shingle")
    heads = written(heads.join(mixed, "shingle"), "mixed")
    a, b = (heads.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "part", "n"))) for x in "ab")
    alike = DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b")
    met = a.join(b, "shingle").where((F.col("part_a") < F.col("part_b")) & alike)
    return salted(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(CLASSES, np.int64)
    for batch in batches:
        seen += np.bincount(batch.column("shingles").flatten().to_numpy() & (CLASSES - 1), minlength=CLASSES)
    at = np.flatnonzero(seen)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["class", "n"])
