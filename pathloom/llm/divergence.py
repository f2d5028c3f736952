"""How far the sources of a language are apart, and which terms set each source off.

A term is a run of letters (A-Z, lower-cased, a-z and all beyond ASCII). A language
keeps the V terms that at least ``MIN_DOCS`` of its documents have. With N a group's
occurrences of kept terms, a term that it has c times gets the share

    p = 1 + floor(SCALE (c + 1) / (N + V))

and the divergence of p from q is floor((p - q)^2 / q). All of it is whole numbers.

Pairs of sources are summed sparsely. A term that neither has adds the same to
every sum, the baseline, V times; a term that one of them has corrects it by what
its count alone says, so counts of counts are enough; only terms that both have
are looked at one by one, in arrays of at most ``CHUNK`` sources a side.

The first ``k`` terms of each group are found by radix selection: a histogram of
the highest bits of the values tells in which bin the k-th lies; what is above it
is in, what is below is out, and the next bits are looked at within the bin alone.
Equal values are told apart by the next two bytes of their terms in the same way.
No group is sorted, and a histogram has a fixed number of bins.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import written

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
#: Sources of a term that travel in one row.
CHUNK = 256
#: Bytes of counts (a term's own and about a hundred around it) that a task holds before it passes them on.
HELD, AROUND = 64 << 20, 128
#: Pairs of sources that a task looks at in one go.
PAIRS = 1 << 20
#: Bits of a value that one histogram looks at.
BITS = 12
#: Letters stay (A-Z as a-z), all other ASCII ends a term.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return text.translate(LETTERS).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it), each triple once, of (lang, source, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list[int]]] = defaultdict(dict)
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), group in held.items():
                n, d = zip(*group.values(), strict=True)
                names = pa.array(list(group), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), names, pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                once: dict[bytes, int] = {}
                for t in terms(text.as_py() or b""):
                    once[t] = once.get(t, 0) + 1
                if not once:
                    continue
                group = held[lang.as_py(), source.as_py()]
                for t, n in once.items():
                    have = group.get(t)
                    if have is None:
                        group[t] = [n, 1]
                        size += len(t) + AROUND
                    else:
                        have[0] += n
                        have[1] += 1
                if size >= HELD:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    each = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | int, total: Column, terms: Column) -> Column:
    """p of a term with this count. Decimals hold what is beyond 64 bits."""
    c = F.lit(count) if isinstance(count, int) else count
    top = (c + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    floor = F.call_function("div", top, F.nullif(total + terms, F.lit(0)).cast("decimal(20,0)"))
    return F.lit(1) + floor


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_sums(rows: DataFrame) -> DataFrame:
    """a, b, value: for groups a and b, what terms that both have add beyond what each alone says.

    ``rows``: arrays ``ga`` and ``gb`` of group numbers with ``pa`` and ``pb``, the
    shares of one term there, and ``za`` and ``zb``, those of a term that the group
    doesn't have. A task sums up what it sees in one go, never all pairs.
    """

    def work(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, a))
        a, b, value = a[order], b[order], value[order]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(np.add.reduceat(value, starts))], ["a", "b", "value"])

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            flat = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("ga", "pa", "za", "gb", "pb", "zb")}
            for k in range(batch.num_rows):
                ga, p, za, gb, q, zb = (v[o[k] : o[k + 1]] for o, v in flat.values())
                value = apart(p[:, None], q) - apart(p[:, None], zb) - apart(za[:, None], q) + apart(za[:, None], zb)
                parts.append((np.repeat(ga, len(gb)), np.tile(gb, len(ga)), value.ravel()))
                size += value.size
                if size >= PAIRS:
                    yield work(parts)
                    parts, size = [], 0
        if parts:
            yield work(parts)

    return rows.mapInArrow(run, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))


def radix_select(rows: DataFrame, k: int) -> DataFrame:
    """Of (gid, value, item) rows those that are among the first k of their group, by value descending, then item (UTF-8 bytes) ascending.

    Values are whole numbers from 0 up; items are distinct within a group.
    """
    live = written(rows.select("gid", "value", "item"), "radix")
    # A bin is a run of bits; all live values of a group agree in the bits above it.
    highest = F.length(F.bin("top")) - BITS
    state = live.groupBy("gid").agg(F.max("value").alias("top")).select("gid", F.lit(k).cast("long").alias("need"), F.greatest(highest, F.lit(0)).alias("shift"))
    inside, tied = [], []
    while not live.isEmpty():
        found, live, state = _narrowed(live.join(state, "gid"), F.call_function("shiftright", "value", "shift"), F.desc("bin"))
        inside.append(found)
        done = state.where("shift = 0").select("gid", "need")
        tied.append(live.join(done, "gid"))
        live = written(live.join(state.where("shift > 0").select("gid"), "gid", "left_semi"), "radix")
        state = state.where("shift > 0").select("gid", "need", F.greatest(F.col("shift") - BITS, F.lit(0)).alias("shift"))
    live = written(reduce(DataFrame.unionByName, tied, live.withColumn("need", F.lit(0).cast("long"))), "radix")
    state = live.groupBy("gid").agg(F.first("need").alias("need"))
    live = live.drop("need")
    while not live.isEmpty():
        # Bytes that all ties of a group share are passed over, so that each round splits every group.
        ends = live.groupBy("gid").agg(F.min("item").alias("low"), F.max("item").alias("high"))
        state = written(state.select("gid", "need").join(ends.mapInPandas(_common, "gid long, shift int"), "gid"), "radix-state")
        digit = F.substring(F.col("item").cast("binary"), F.col("shift") + 1, F.lit(2))
        found, live, state = _narrowed(live.join(state, "gid"), digit, F.asc("bin"))
        inside.append(found)
    return reduce(DataFrame.unionByName, inside, live)


def _narrowed(rows: DataFrame, digit: Column, order: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that are in, rows of the bin with the k-th that are open still, and of their groups gid, need and shift."""
    rows = rows.withColumn("bin", digit)
    bins = rows.groupBy("gid", "bin").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("shift").alias("shift"))
    upto = bins.withColumn("upto", F.sum("n").over(W.partitionBy("gid").orderBy(order)))
    # Each bin is wholly in, wholly out, or the one that is open.
    fate = upto.select("gid", "bin", "shift", (F.col("upto") <= F.col("need")).alias("in"), (F.col("need") - F.col("upto") + F.col("n")).alias("left")).where("in OR left > 0")
    fate = written(fate, "radix-bins")
    marked = written(rows.select("gid", "value", "item", "bin").join(fate.select("gid", "bin", "in"), ["gid", "bin"]).drop("bin"), "radix-marked")
    return marked.where("in").drop("in"), marked.where("NOT in").drop("in"), fate.where("NOT in").select("gid", F.col("left").alias("need"), "shift")


def _common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        shared = [len(os.path.commonprefix([x.encode(), y.encode()])) for x, y in zip(b["low"], b["high"], strict=True)]
        yield pd.DataFrame({"gid": b["gid"], "shift": shared})


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank (from 1 for each group and part; larger values first, then items by UTF-8 bytes).

    Part ``pair``: how far the group's shares are from those of each other source
    of its language (item), summed over all kept terms; every pair is there, with 0
    if no term is kept. Part ``term``: the kept terms that the group has a larger
    share of than its language, the first ``k``.

    Null lang, source and text count as empty. Each row is a document, also where
    ids repeat. A group without terms has pairs but no terms. Only the three
    columns are read. An empty table gives an empty table.
    """
    docs = df.select(*(F.coalesce(df[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = written(counted(docs), "term-counts")
    # How often a language has a term, over all its documents.
    words = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    kept = written(counts.select("lang", "source", "term", "n").join(words.select("lang", "term", "lang_n"), ["lang", "term"]), "kept-terms")
    langs = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total"))).withColumn("zero", share(0, F.col("total"), F.col("v")))
    at = F.row_number().over(W.partitionBy("lang").orderBy("source"))  # for the chunks
    groups = written(groups.withColumns({"gid": F.monotonically_increasing_id(), "chunk": F.floor((at - 1) / CHUNK).cast("int")}), "groups")
    shares = written(kept.join(groups, ["lang", "source"]).select("lang", "term", "gid", "chunk", "n", "zero", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "shares")

    # Pairs: the baseline, what each side's counts correct, what terms that both have add.
    ours = groups.select(F.col("gid").alias("a"), "lang", F.col("zero").alias("za"))
    theirs = groups.select(F.col("gid").alias("b"), "lang", F.col("zero").alias("zb"), "v")
    both = ours.join(theirs, "lang").where("a != b").withColumn("base", F.when(F.col("v") > 0, divergence(F.col("za"), F.col("zb"))).otherwise(0))
    sums = both.select("a", "b", (F.col("v") * F.col("base")).alias("value"))
    often = written(shares.groupBy("gid", "p").agg(F.count("*").alias("n")), "counts-of-counts")
    left = both.join(often, F.col("a") == F.col("gid")).select("a", "b", (F.col("n") * (divergence(F.col("p"), F.col("zb")) - F.col("base"))).alias("value"))
    right = both.join(often, F.col("b") == F.col("gid")).select("a", "b", (F.col("n") * (divergence(F.col("za"), F.col("p")) - F.col("base"))).alias("value"))
    listed = shares.groupBy("lang", "term", "chunk").agg(F.collect_list(F.struct("gid", "p", "zero")).alias("x"))  # at most CHUNK
    side = lambda s: listed.select("lang", "term", *(F.col(f"x.{c}").alias(f"{n}{s}") for c, n in (("gid", "g"), ("p", "p"), ("zero", "z"))))
    met = shared_sums(side("a").join(side("b"), ["lang", "term"]).drop("lang", "term")).where("a != b")
    value = sums.unionByName(left).unionByName(right).unionByName(met).groupBy("a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("gid", "lang", "source")
    pair = value.join(names.withColumnRenamed("gid", "a"), "a").join(names.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    over = shares.where("p > q").select("gid", divergence(F.col("p"), F.col("q")).alias("value"), F.col("term").alias("item"))
    first = radix_select(over, k).join(names, "gid")
    term = first.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pair.unionByName(term).withColumn("rank", rank.cast("int"))
