"""Mixing sources to target weights, exactly to the word.

Each source has a weight; its target is its share of the whole, but at most
``cap`` times its size, what it can't take going to the others by weight. Within
a source, documents stand in the order of a hash-random key. The words before a
document are a distributed prefix sum: keys are cut into ranges, about the root
of the source's rows in number, so that both the ranges of a source and the rows
of a range stay small however large the source is. A document is taken once for
each whole epoch the target holds, and once more, as far as the budget goes, in
the last part of an epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds source_no (by code point, null last, from 0) and target to (source, source_size, rows).

    One row a source. In the order of cap over weight, a source is stopped at its
    cap if what is left, shared by weight among it and those after it, gives it
    more; the first that isn't stopped tells the share of a unit of weight.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    numbered = sources.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double"))
    at_most = F.lit(float(cap)) * F.col("source_size")
    ordered = W.orderBy(at_most / F.col("weight"), "source_no")
    before = F.coalesce(F.sum(at_most).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    unit = weighed.withColumn("at_most", at_most).withColumn("unit", (budget - before) / weights_left)
    first = F.first(F.when(F.col("unit") <= F.col("at_most") / F.col("weight"), F.col("unit")), ignorenulls=True)
    # Without any that isn't stopped (share at cap or above), all take their caps.
    given = F.coalesce(first.over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.col("weight"), F.col("at_most"))
    return unit.withColumn("target", F.least("at_most", given)).drop("weight", "at_most", "unit")


def mix(
    df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every row.

    A null text has size 0 and is not taken; null is a source of its own. The key
    is a hash of id and text, a null id or text counting as empty, so that rows
    without an id, or of one id, are dealt over all ranges too. Rows with equal id
    and text are interchangeable, so reruns agree. Other columns are not read. An
    empty table gives an empty table. ``row_col`` may name a row's own number: it
    is returned too, as row.
    """
    own = [] if row_col is None else ["row"]
    marks = [] if row_col is None else [df[row_col].alias("row")]
    text = F.md5(F.coalesce(df[text_col], F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(df[id_col].cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    sized = written(df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), word_count(df[text_col]).alias("size"), key.alias("key"), *marks), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aims = written(targets(sources, weights, share, cap), "targets")

    ranges = F.ceil(F.sqrt("rows"))
    in_key = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = (
        sized.alias("d")
        .join(aims.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "d.source", "size", "key", *own, "source_no", "source_size", "target", F.floor(in_key * ranges / F.lit(1 << 32)).cast("long").alias("range"))
    )
    sums = placed.groupBy("source_no", "range").agg(F.sum("size").alias("words"))
    before = sums.select("source_no", "range", F.coalesce(F.sum("words").over(W.partitionBy("source_no").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("source_no", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    return placed.join(before, ["source_no", "range"]).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *own)
