"""Trajectory measures by dynamic programming: DTW, EDR, ERP and LCSS.

Points are structs with x and y, in order. Each measure folds over the rows of
its table and, within a row, over the cells, as nested array aggregations: no
Python runs. A row is rebuilt cell by cell, so a pair costs about m n (n + 1) / 2
steps; for long trajectories ``operators.measure_search`` gives the same over blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.functions import geo

PointDistance = Callable[[Column, Column], Column]


def planar(p: Column, q: Column) -> Column:
    return geo.euclid(p["x"], p["y"], q["x"], q["y"])


def on_earth(p: Column, q: Column) -> Column:
    return geo.haversine(p["x"], p["y"], q["x"], q["y"])


def _table(t1: Column, t2: Column, border: Column, first: Callable[[Column, Column], Column], cell: Callable[..., Column]) -> Column:
    """The last cell of a table: ``first(previous first cell, p)`` begins a row, ``cell(up_left, up, left, p, q, i, j)`` goes on."""

    def row(above: Column, i: Column) -> Column:
        p = F.get(t1, i)
        start = F.array(first(above[0], p))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(t2) - 1),
            start,
            lambda done, j: F.concat(done, F.array(cell(F.get(above, j), F.get(above, j + 1), F.element_at(done, -1), p, F.get(t2, j), i, j))),
        )

    return F.element_at(F.aggregate(F.sequence(F.lit(0), F.size(t1) - 1), border, row), -1)


def _filled(t1: Column, t2: Column, value: Column, if_empty: Column) -> Column:
    return F.when((F.size(t1) > 0) & (F.size(t2) > 0), value).otherwise(if_empty)


def dtw(t1: Column, t2: Column, distance: PointDistance = planar) -> Column:
    """Dynamic time warping: the sum of costs; null if one is empty."""
    inf = F.lit(float("inf"))
    border = F.concat(F.array(F.lit(0.0)), F.transform(t2, lambda q: inf))
    value = _table(t1, t2, border, lambda above, p: inf, lambda ul, up, left, p, q, i, j: distance(p, q) + F.least(ul, up, left))
    return _filled(t1, t2, value, F.lit(None).cast("double"))


def edr(t1: Column, t2: Column, threshold: float, distance: PointDistance = planar) -> Column:
    """Edit distance on real sequences: points match within the threshold."""
    border = F.transform(F.sequence(F.lit(0), F.size(t2)), lambda j: j.cast("double"))
    value = _table(
        t1, t2, border, lambda above, p: above + 1.0, lambda ul, up, left, p, q, i, j: F.least(ul + F.when(distance(p, q) <= threshold, 0.0).otherwise(1.0), up + 1.0, left + 1.0)
    )
    return _filled(t1, t2, value, F.greatest(F.size(t1), F.size(t2)).cast("double"))


def erp(t1: Column, t2: Column, gap: tuple[float, float] = (0.0, 0.0), distance: PointDistance = planar) -> Column:
    """Edit distance with real penalty: a gap costs the distance to the gap point."""
    g = F.struct(F.lit(float(gap[0])).alias("x"), F.lit(float(gap[1])).alias("y"))
    running = F.aggregate(t2, F.array(F.lit(0.0)), lambda done, q: F.concat(done, F.array(F.element_at(done, -1) + distance(q, g))))
    value = _table(
        t1, t2, running, lambda above, p: above + distance(p, g), lambda ul, up, left, p, q, i, j: F.least(ul + distance(p, q), up + distance(p, g), left + distance(q, g))
    )
    total = lambda t: F.aggregate(t, F.lit(0.0), lambda a, p: a + distance(p, g))
    return _filled(t1, t2, value, total(t1) + total(t2))


def lcss(t1: Column, t2: Column, threshold: float, delta: int, distance: PointDistance = planar, normalized: bool = False) -> Column:
    """Points outside the longest common subsequence, m + n - 2 L; with ``normalized``, 1 - L / (m + n - L).

    Points match within the threshold if their places differ by at most delta.
    """
    border = F.concat(F.array(F.lit(0)), F.transform(t2, lambda q: F.lit(0)))
    match = lambda p, q, i, j: (distance(p, q) <= threshold) & (F.abs(i - j) <= delta)
    length = _table(t1, t2, border, lambda above, p: F.lit(0), lambda ul, up, left, p, q, i, j: F.when(match(p, q, i, j), ul + 1).otherwise(F.greatest(up, left)))
    length = _filled(t1, t2, length, F.lit(0))
    both = F.size(t1) + F.size(t2)
    if normalized:
        return F.lit(1.0) - length / F.nullif(both - length, F.lit(0))
    return (both - 2 * length).cast("double")


def measure_topk(queries: DataFrame, data: DataFrame, measure: Callable[[Column, Column], Column], k: int, ascending: bool = True, points: str = "pts") -> DataFrame:
    """qid, rank, tid, dist: the k nearest (or farthest) trajectories of each query, ties to the smaller tid.

    Queries are a stated set; each is compared with all rows of ``data``, itself included.
    """
    q = queries.select(F.col("tid").alias("qid"), F.col(points).alias("q_pts"))
    pairs = q.join(data.select("tid", F.col(points).alias("d_pts")), F.lit(True)).select("qid", "tid", measure(F.col("q_pts"), F.col("d_pts")).alias("dist"))
    order = F.col("dist").asc_nulls_last() if ascending else F.col("dist").desc_nulls_last()
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(order, "tid"))).where(F.col("rank") <= k).select("qid", "rank", "tid", "dist")
