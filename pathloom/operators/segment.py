"""Cutting GPS logs into trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import geo


#: Seconds, or numbers of an order column, that a piece of a log spans.
PIECE_SECONDS, PIECE_NUMBERS = 86_400, 1 << 17


def gap_segments(fixes: DataFrame, gap_seconds: float, key: str = "file", order: tuple[str, ...] = ("ts", "line")) -> DataFrame:
    """Adds seg, from 0 in each key: a fix ``gap_seconds`` or more after the one before begins a new segment.

    A key's fixes are cut into pieces by their first order column, so that a long
    log isn't one task's work. Gaps are found within pieces; the borders, a row a
    piece, are then stitched.
    """
    by_time = fixes.schema[order[0]].dataType.typeName().startswith("timestamp")
    piece = F.floor(F.unix_micros(order[0]) / (PIECE_SECONDS * 1_000_000)) if by_time else F.floor(F.col(order[0]) / PIECE_NUMBERS)
    seconds = F.unix_micros("ts") / 1e6
    w = W.partitionBy(key, "_piece").orderBy(*order)
    cut = fixes.withColumn("_piece", piece)
    inside = cut.withColumn("_new", F.coalesce((seconds - F.lag(seconds).over(w) >= gap_seconds).cast("long"), F.lit(0).cast("long")))
    place = F.struct(*order, seconds.alias("_s"))
    ends = inside.groupBy(F.col(key).alias("_key"), F.col("_piece").alias("_of")).agg(F.sum("_new").alias("_n"), F.min(place).alias("_a"), F.max(place).alias("_z"))
    pieces = W.partitionBy("_key").orderBy("_of")
    gap = F.coalesce((F.col("_a._s") - F.lag("_z._s").over(pieces) >= gap_seconds).cast("long"), F.lit(0).cast("long"))
    ahead = F.sum(F.col("_gap") + F.col("_before")).over(pieces.rowsBetween(W.unboundedPreceding, 0))
    base = ends.withColumns({"_gap": gap, "_before": F.lag("_n", 1, 0).over(pieces)}).select("_key", "_of", ahead.alias("_base"))
    numbered = inside.withColumn("_in", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    both = numbered.join(base, F.col(key).eqNullSafe(F.col("_key")) & F.col("_piece").eqNullSafe(F.col("_of")))
    return both.select(*fixes.columns, (F.col("_base") + F.col("_in")).alias("seg"))


def segment_stats(segments: DataFrame, key: str = "file", order: tuple[str, ...] = ("ts", "line")) -> DataFrame:
    """key, seg, n_points and the distance in metres from first to last fix."""
    at = F.struct(*order, "x", "y")
    ends = segments.groupBy(key, "seg").agg(F.count("*").alias("n_points"), F.min(at).alias("a"), F.max(at).alias("b"))
    return ends.select(key, "seg", "n_points", geo.haversine(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")).alias("metres"))


def long_enough(stats: DataFrame, min_points: int = 30, min_metres: float = 2000.0) -> DataFrame:
    return stats.where((F.col("n_points") >= min_points) & (F.col("metres") >= min_metres))


def segment(
    fixes: DataFrame, gap_seconds: float = 1800.0, max_points: int = 50, min_points: int = 30, min_metres: float = 2000.0, key: str = "file", order: tuple[str, ...] = ("line",)
) -> DataFrame:
    """Trajectories of each key's fixes: key, seg, n, x, y, ts for each kept fix.

    In order, a trajectory ends at a gap of ``gap_seconds`` or more, or with
    ``max_points`` kept fixes. A fix that follows is kept if it differs from the fix
    before it, kept or not, in x and in y; the first of a trajectory always is.
    Trajectories with fewer than ``min_points`` fixes or less than ``min_metres``
    between their ends are dropped, except the last one of all, which isn't judged.
    Segments are numbered from 0 in each key, dropped ones left out. Fixes without
    a time are not used.

    The fold is sequential within a stretch without gaps, so fixes are dealt out by
    stretch and sorted, and each task folds its stretches as they stream by: a key's
    stretches are spread over tasks, and a task holds a few numbers.
    """
    stretches = gap_segments(fixes.where("ts IS NOT NULL"), gap_seconds, key, order).withColumnRenamed("seg", "stretch")
    kind = fixes.schema[key].dataType.simpleString()
    rows = stretches.select(key, "stretch", *(c for c in order if c != "ts"), "ts", "x", "y").repartition(key, "stretch").sortWithinPartitions(key, "stretch", *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, part, n, last = None, 0, 0, (0.0, 0.0)
        for batch in batches:
            keys, runs, xs, ys = (batch.column(c).to_pylist() for c in (key, "stretch", "x", "y"))
            keep, parts, places = [], [], []
            for i, here in enumerate(zip(keys, runs, strict=True)):
                now = (xs[i], ys[i])
                if here != where:
                    where, part, n = here, 0, 0
                elif n >= max_points:
                    part, n = part + 1, 0
                if n == 0 or (now[0] != last[0] and now[1] != last[1]):
                    keep.append(i)
                    parts.append(part)
                    places.append(n)
                    n += 1
                last = now
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(key), kept.column("stretch"), pa.array(parts, pa.int64()), pa.array(places, pa.int64()), *(kept.column(c) for c in ("ts", "x", "y"))], [key, "stretch", "part", "n", "ts", "x", "y"]
            )

    folded = rows.mapInArrow(fold, f"{key} {kind}, stretch long, part long, n long, ts {fixes.schema['ts'].dataType.simpleString()}, x double, y double")
    at = F.struct("n", "x", "y")
    ends = folded.groupBy(key, "stretch", "part").agg(F.count("*").alias("size"), F.min(at).alias("a"), F.max(at).alias("b"))
    place = F.struct(key, "stretch", "part")
    top = ends.agg(F.max(place).alias("top"))  # one row
    judged = (F.col("size") >= min_points) & (geo.haversine(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) >= min_metres)
    good = ends.join(F.broadcast(top), F.lit(True)).where((place == F.col("top")) | judged)
    numbered = good.select(key, "stretch", "part", (F.row_number().over(W.partitionBy(key).orderBy("stretch", "part")) - 1).alias("seg"))
    return folded.join(numbered, [key, "stretch", "part"]).select(key, "seg", "n", "ts", "x", "y")

