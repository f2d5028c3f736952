"""Assembling, sampling and summarising trajectories.

Long form is the source of truth: points(tid, pid, ts, x, y, terms). Nested form,
traj(tid, pts), exists where an operator needs a trajectory's points together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.functions.draws import RANGE, draw_int


def placed(points: DataFrame) -> DataFrame:
    """The points that have a place: x and y that are neither null nor NaN nor infinite. Null keywords count as none."""
    return points.where(geo.finite(F.col("x")) & geo.finite(F.col("y"))).withColumn("terms", F.array_compact(F.coalesce("terms", F.array().cast("array<string>"))))


def assemble(points: DataFrame) -> DataFrame:
    """tid, pts: the points of each trajectory as structs in order of pid."""
    fields = ["pid", *(c for c in ("ts", "x", "y", "terms") if c in points.columns)]
    return points.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pts"))


def counts(points: DataFrame) -> DataFrame:
    """One row: trajectories, points and distinct keywords."""
    keywords = points.select(F.explode("terms").alias("kw")).distinct().agg(F.count("*").alias("keywords"))
    return points.agg(F.countDistinct("tid").alias("trajectories"), F.count("*").alias("points")).join(F.broadcast(keywords), F.lit(True))  # one row each


def boxes(points: DataFrame) -> DataFrame:
    """tid, number of points and bounding box."""
    return points.groupBy("tid").agg(F.count("*").alias("n_points"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def cells(points: DataFrame, grid: float) -> DataFrame:
    """The distinct grid cells of each trajectory: tid, cx, cy."""
    return points.select("tid", geo.cell(F.col("x"), grid).alias("cx"), geo.cell(F.col("y"), grid).alias("cy")).distinct()


def postings(points: DataFrame) -> DataFrame:
    """The inverted list, once for each trajectory and keyword: kw, tid."""
    return points.select(F.explode("terms").alias("kw"), "tid").distinct()


def summary(points: DataFrame, grid: float) -> DataFrame:
    """tid, n_points, box, and the sets of grid cells and keywords."""
    cell = F.struct(geo.cell(F.col("x"), grid).alias("cx"), geo.cell(F.col("y"), grid).alias("cy"))
    return boxes(points).join(points.groupBy("tid").agg(F.array_sort(F.collect_set(cell)).alias("cells"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("term_set")), "tid")


def terms_with_repeats(points: DataFrame) -> DataFrame:
    """tid, pid, term: every keyword of every point."""
    return points.select("tid", "pid", F.explode("terms").alias("term"))


def sample_queries(points: DataFrame, n: int, seed: int = 48) -> DataFrame:
    """The points of n trajectories, drawn by hash without replacement (all, if there are fewer)."""
    ids = points.select("tid").distinct().orderBy(draw_int("tid", seed=seed), "tid").limit(n)
    return points.join(F.broadcast(ids), "tid", "left_semi") if n <= 100_000 else points.join(ids, "tid", "left_semi")


def sample(points: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """0 and 1: all; below 1: about this share of trajectories; above 1: int(fraction) copies of each.

    Copy c of trajectory t has the id t * int(fraction) + c, so ids stay distinct.
    """
    if 0 < fraction < 1:
        return points.where(draw_int("tid", seed=seed) < int(fraction * RANGE))
    if fraction > 1:
        n = int(fraction)
        copies = points.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return copies.withColumn("tid", F.col("tid") * n + F.col("_copy")).drop("_copy")
    return points


def first_ids(points: DataFrame, n: int) -> DataFrame:
    """The trajectories with ids below n (prefix experiments)."""
    return points.where(F.col("tid") < n)


def sub_trajectory(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points of each trajectory, drawn by hash, in their order; shorter ones stay whole."""
    place = F.row_number().over(W.partitionBy("tid").orderBy(draw_int("tid", "pid", seed=seed), "pid"))
    return points.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def shuffled(rows: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Rows in an order by hash that every run repeats."""
    return rows.orderBy(draw_int(id_col, seed=seed), id_col)


def dedupe_moves(fixes: DataFrame, partition: str | list[str] = "tid", order: str = "pid") -> DataFrame:
    """Fixes that differ from the one before in x and in y; the first always stays."""
    w = W.partitionBy(*([partition] if isinstance(partition, str) else partition)).orderBy(order)
    before = fixes.withColumns({"_x": F.lag("x").over(w), "_y": F.lag("y").over(w), "_n": F.row_number().over(w)})
    return before.where((F.col("_n") == 1) | ((F.col("x") != F.col("_x")) & (F.col("y") != F.col("_y")))).drop("_x", "_y", "_n")
