"""An index of vectors by cells: inverted lists around coarse centres.

Centres are found by k-means on a bounded sample. Every vector is written with the
cell of its nearest centre, as blocks in a Parquet table that is partitioned by
cell. A query asks the cells of its nearest centres alone: their partitions are
read and no others, and within them distances are exact. With all cells asked, the
search is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.draws import draw_int
from pathloom.operators.blocks import meet, numbered_blocks
from pathloom.operators.knn import BLOCK, FOUND, alike, asked_blocks, block_nearest, check_dimensions, comparable, distances, nearest, packed, searcher
from pathloom.plans.params import CellParams
from pathloom.plans.storage import scratch


def k_means(rows: np.ndarray, n: int, rounds: int, seed: int = 0) -> np.ndarray:
    """n centres (fewer, if there are fewer different rows) by Lloyd's rounds; a centre that nothing is near to moves to the row farthest from its own."""
    rows = np.unique(rows, axis=0)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:n]]
    for _ in range(rounds):
        d = np.concatenate([distances(rows[at : at + 256], centres, "l2") for at in range(0, len(rows), 256)])
        own = d.argmin(axis=1)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        lost = np.flatnonzero(size == 0)
        centres[lost] = rows[np.argsort(-d[np.arange(len(rows)), own], kind="stable")[: len(lost)]]
    return centres


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(n > 0, n, 1)


def build(data: DataFrame, path: str, params: CellParams = CellParams(), metric: str = "l2") -> None:
    """Write the index of vectors (id, vec) to ``path``: ``centres`` and ``cells``.

    Centres are fitted on at most ``params.sample`` rows, drawn by hash; every row
    that takes part (see ``knn``) is indexed. By cosine, vectors are dealt by their
    direction. A cell with many rows is many blocks, in as many files as its rows need.
    """
    spark = data.sparkSession
    rows = comparable(data)
    some = rows.select(F.size("vec").alias("d")).first()
    rows = check_dimensions(rows, some["d"] if some else 0)
    shaped = _unit if metric == "cosine" else lambda x: x
    drawn = rows.orderBy(draw_int("id"), "id").limit(params.sample).select("vec").collect()
    centres = k_means(shaped(np.array([r["vec"] for r in drawn], float)), params.cells, params.rounds) if drawn else np.empty((0, 0))
    listed = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(listed, "cell int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                d = distances(shaped(np.array([*part["vec"]], float)), centres, "l2")
                yield part.assign(cell=d.argmin(axis=1))

    # By cell and a hash of the id: a cell that holds a third of all rows spreads over ranges.
    placed = rows.mapInPandas(dealt, "id long, vec array<double>, cell int").withColumn("draw", draw_int("id"))
    ranged = placed.repartitionByRange("cell", "draw").sortWithinPartitions("cell", "draw")
    packed(ranged, BLOCK, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # one a cell
    return np.array([r["cell"] for r in rows], int), np.array([r["vec"] for r in rows], float)


def _asked(queries: DataFrame, path: str, probes: int, metric: str) -> DataFrame:
    """id, vec, cell: each query once for each of the ``probes`` cells whose centres are nearest."""
    cells, centres = _centres(queries.sparkSession, path)
    shaped = _unit if metric == "cosine" else lambda x: x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(cells):
                d = distances(shaped(np.array([*b["vec"]], float)), centres, "l2")
                order = np.argsort(d, axis=1, kind="stable")[:, :probes]
                yield b.loc[b.index.repeat(order.shape[1])].assign(cell=cells[order.ravel()])

    return queries.mapInPandas(run, "id long, vec array<double>, cell int")


def search(queries: DataFrame, path: str, k: int, probes: int = CellParams().probes, metric: str = "l2", with_self: bool = True) -> DataFrame:
    """qid, rank, id, dist: about the k nearest rows of each query, from the ``probes`` cells nearest to it.

    Rows, nulls, ties and empty tables as in ``knn.knn_exact``. A query finds fewer
    than k rows if its cells hold fewer.
    """
    spark = queries.sparkSession
    queries, _ = alike(queries, queries)
    probed = _asked(queries, path, probes, metric).repartition("cell").sortWithinPartitions("cell")
    asked = asked_blocks(probed, "cell").withColumnRenamed("cell", "q_cell")
    wanted = [r["q_cell"] for r in asked.select("q_cell").distinct().collect()]  # no more than there are cells
    # A list of cells, so that the scan opens their folders alone.
    table = spark.read.schema("ids binary, matrix binary, width int, cell int").parquet(f"{path}/cells") if wanted else None
    read = table.where(F.col("cell").isin(wanted)) if wanted else spark.createDataFrame([], "ids binary, matrix binary, width int, cell int")
    blocks = numbered_blocks(read)
    pairs = asked.select("q_block", F.col("q_cell").alias("cell")).join(blocks.select("block", "cell"), "cell").select("q_block", "block")
    return nearest(meet(blocks, asked, pairs, searcher(block_nearest(k, metric, with_self)), FOUND), k)


def shares_read(queries: DataFrame, path: str, probes: int = CellParams().probes, metric: str = "l2") -> DataFrame:
    """qid, share: of all indexed rows those that a search compares with each query."""
    spark = queries.sparkSession
    queries, _ = alike(queries, queries)
    size = spark.read.schema("ids binary, cell int").parquet(f"{path}/cells").groupBy("cell").agg(F.sum(F.octet_length("ids") / 8).alias("n"))
    total = size.agg(F.sum("n").alias("total"))
    each = _asked(queries, path, probes, metric).select(F.col("id").alias("qid"), "cell").join(size, "cell", "left").groupBy("qid").agg(F.sum("n").alias("n"))
    return each.join(F.broadcast(total), F.lit(True)).select("qid", (F.coalesce("n", F.lit(0.0)) / F.col("total")).alias("share"))  # one row


def knn_approx(queries: DataFrame, data: DataFrame, k: int, params: CellParams = CellParams(), metric: str = "l2") -> DataFrame:
    """About the k nearest rows of each query: an index in the shared folder, built once and then searched."""
    path = scratch(data.sparkSession, "cells")
    build(data, path, params, metric)
    return search(queries, path, k, params.probes, metric)
