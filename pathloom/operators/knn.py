"""Nearest neighbours over versioned vectors, exact and with pivots; upserts and removals.

Vector tables: id (long), vec (array of float or double); versioned ones also
have version (long). Queries are a stated set, compared with all rows in blocks.

Rows without an id, and vectors that are null or hold a null, NaN or infinite
component, take no part. All vectors that do must have the same length; another is
an error. By cosine a vector of length 0 has no distance: null, which ranks last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.draws import RANGE, draw_int
from pathloom.operators.blocks import every_pair, meet, numbered_blocks
from pathloom.plans.storage import kept

BLOCK, QUERY_BLOCK = 4096, 1024
#: Queries whose distances to a block are worked out at a time, and pairs of which all differences are held.
AT_ONCE, PAIRS = 32, 16_384
#: Distances that agree to so many places are ties.
DIGITS = 12
FOUND = "qid long, id long, dist double"
#: Rows of a block of ``extremes``, and what rounding may add to a bound.
EXTREME_BLOCK, SLACK = 8192, 1e-9
#: Rows of such a block that meet another block at a time.
MANY = 128


def usable(vec: Column) -> Column:
    """Whether a vector can be compared: not null, and all its components finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False))


def comparable(vectors: DataFrame) -> DataFrame:
    """id and vec (double) of the rows that take part."""
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("vec")))
    return rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))


def check_dimensions(vectors: DataFrame, d: int) -> DataFrame:
    """The rows; a vector of another length than d is an error."""
    return vectors.withColumn("vec", F.when(F.size("vec") == d, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit(f"vector of other length than {d}: id "), F.col("id").cast("string"))).cast("array<double>")))


def alike(queries: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables as ``comparable`` rows of one length, that of some query."""
    queries, data = comparable(queries), comparable(data)
    some = queries.select(F.size("vec").alias("d")).first()
    d = some["d"] if some else 0
    return check_dimensions(queries, d), check_dimensions(data, d) if some else data.where("false")


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - a @ b.T / norm
    # By differences, not by the expanded square, so that equal vectors are at 0.
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by the expanded square, a matrix product, and how far rounding may put them off; that isn't finite for huge numbers."""
    with np.errstate(over="ignore", invalid="ignore"):
        x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
        d = a @ (-2 * b.T)
        d += x[:, None]
        d += y
        return d, float((x.max(initial=0) + y.max(initial=0)) * (a.shape[1] + 8) * 1e-15)


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``distances`` by L2 of single pairs of rows, with a bound on what is held."""
    cuts = [(i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
    return np.concatenate([np.empty(0), *(np.sqrt(((a[x] - b[y]) ** 2).sum(axis=1)) for x, y in cuts)])


def packed(rows: DataFrame, size: int, key: str | None = None) -> DataFrame:
    """(id, vec) rows as blocks of at most ``size``: ids, matrix, width; with ``key``, blocks of one key each, of rows sorted by it."""
    by = key or "none"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(batch[by], batch["id"], batch["vec"], strict=True):
                if held and (len(held) == size or held[-1][0] != row[0]):
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    def one(part):
        matrix = np.array([v for _, _, v in part], "<f8").reshape(len(part), -1)
        return pd.DataFrame({by: [part[0][0]], "ids": [np.array([i for _, i, _ in part], "<i8").tobytes()], "matrix": [matrix.tobytes()], "width": [matrix.shape[1]]})

    named = rows.select(F.col(key).cast("int").alias(key) if key else F.lit(0).alias(by), "id", "vec")
    out = named.mapInPandas(pack, f"{by} int, ids binary, matrix binary, width int")
    return out if key else out.drop(by)


def asked_blocks(queries: DataFrame, key: str | None = None) -> DataFrame:
    return numbered_blocks(packed(queries, QUERY_BLOCK, key), "q_block").withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix", "width": "q_width"})


def held_block(x: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x["matrix"]).reshape(-1, x["width"]), np.frombuffer(x["ids"], "<i8")


def searcher(search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple]) -> Callable[[], tuple[Callable, Callable]]:
    """For ``meet``: rows of FOUND that ``search(vectors, ids, query vectors, query ids)`` finds; a distance that isn't finite is null."""

    def step(held: tuple[np.ndarray, np.ndarray], x: dict) -> pa.RecordBatch:
        own = np.frombuffer(x["q_ids"], "<i8")
        row, found, dist = search(*held, np.frombuffer(x["q_matrix"]).reshape(-1, x["q_width"]), own)
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(found), pa.array(dist, mask=~np.isfinite(dist))], ["qid", "id", "dist"])

    return lambda: (held_block, step)


def _searched(queries: DataFrame, data: DataFrame, search: Callable) -> DataFrame:
    queries, data = alike(queries, data)
    blocks, asked = numbered_blocks(packed(data, BLOCK)), asked_blocks(queries)
    return meet(blocks, asked, every_pair(asked, blocks), searcher(search), FOUND)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """qid, rank, id, dist of each query's k nearest, ties to the smaller id, those without a distance last."""
    w = W.partitionBy("qid").orderBy(F.asc_nulls_last("dist"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def block_nearest(k: int, metric: str, with_self: bool = True) -> Callable:
    """The search of one block: the k nearest rows of each query, ties to the smaller id, those without a distance last."""

    def search(v, ids, q, own):
        rows, found, dist = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for at in range(0, len(q), AT_ONCE):
            part = q[at : at + AT_ONCE]
            off = np.inf
            if metric == "l2":
                d, off = squares(part, v)
            if not np.isfinite(off):
                d, off = np.round(distances(part, v, metric), DIGITS), 0.0
                squared = False
            else:
                squared = True
            d[np.isnan(d)] = np.inf  # no distance is farther than any
            wanted = np.ones(d.shape, bool) if with_self else own[at : at + AT_ONCE, None] != ids[None, :]
            last = min(k, d.shape[1]) - 1
            cut = np.partition(np.where(wanted, d, np.inf), last, axis=1)[:, last]
            if squared:  # rows that rounding, of squares or of distances, may put among the nearest
                far = np.sqrt(np.maximum(cut, 0) + 2 * off) + 2 * 10.0**-DIGITS
                cut = far * far + 2 * off
            r, c = np.nonzero((d <= cut[:, None]) & wanted)
            exact = np.round(pair_distances(part, v, r, c), DIGITS) if squared else d[r, c]
            order = np.lexsort((ids[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            rows.append(r[keep] + at)
            found.append(ids[c[keep]])
            dist.append(exact[keep])
        return np.concatenate(rows), np.concatenate(found), np.concatenate(dist)

    return search


def knn_exact(queries: DataFrame, data: DataFrame, k: int, metric: str = "l2", with_self: bool = True) -> DataFrame:
    """qid, rank, id, dist: the k nearest rows of each query, ties to the smaller id; all rows, if there are fewer.

    Without self, rows with the query's id are left out. Rows of ``data`` that repeat
    an id are rows each. Which rows take part is said above; empty tables give no
    rows. Other columns are not read.
    """
    return nearest(_searched(queries, data, block_nearest(k, metric, with_self)), k)


def _pivot_search(queries: DataFrame, data: DataFrame, k: int, n_pivots: int) -> DataFrame:
    """qid, id, dist, and for each query and block a row with dist -1 whose id is the number of distances worked out."""
    pivots = np.array([r["vec"] for r in comparable(data).orderBy(draw_int("id"), "id").limit(n_pivots).select("vec").collect()], float)

    def search(v, ids, q, own):
        to_v, to_q = distances(v, pivots, "l2"), distances(q, pivots, "l2")
        rows, found, dist = [], [], []
        for i, x in enumerate(q):
            # No row is nearer than the largest difference of distances to a pivot.
            least = np.abs(to_v - to_q[i]).max(axis=1)
            first = np.argpartition(least, min(4 * k, len(v)) - 1)[: 4 * k]
            near = np.round(distances(x[None], v[first], "l2")[0], DIGITS)
            kth = np.partition(near, min(k, len(near)) - 1)[min(k, len(near)) - 1]
            rest = least <= kth + 1e-9
            rest[first] = False
            rest = np.flatnonzero(rest)
            which, near = np.append(first, rest), np.append(near, np.round(distances(x[None], v[rest], "l2")[0], DIGITS))
            best = np.flatnonzero(near <= np.partition(near, min(k, len(near)) - 1)[min(k, len(near)) - 1])
            rows.append(np.full(len(best) + 1, i))
            found.append(np.append(ids[which[best]], len(which)))
            dist.append(np.append(near[best], -1.0))
        return np.concatenate(rows), np.concatenate(found), np.concatenate(dist)

    return _searched(queries, data, search)


def knn_pivot_pruned(queries: DataFrame, data: DataFrame, k: int, n_pivots: int = 8) -> DataFrame:
    """The k nearest rows by L2, exactly, with the triangle inequality in each block.

    Distances to a few pivots bound every other distance from below; only rows whose
    bound is within the k-th best distance so far are compared. Rows, nulls, ties
    and empty tables as in ``knn_exact``.
    """
    return nearest(_pivot_search(queries, data, k, n_pivots).where("dist >= 0"), k)


def pivot_costs(queries: DataFrame, data: DataFrame, k: int, n_pivots: int = 8) -> DataFrame:
    """qid, compared: the distances that ``knn_pivot_pruned`` works out for each query, pivots left out."""
    return _pivot_search(queries, data, k, n_pivots).where("dist < 0").groupBy("qid").agg(F.sum("id").alias("compared"))


def extremes(data: DataFrame, n_pivots: int = 8) -> DataFrame:
    """One row: pairs (compared), min_dist, max_dist and equal_pairs over all pairs of different rows (id, vec), by L2.

    Blocks of vectors near one another meet in an upper triangle. Distances to a few
    pivots bound those of a pair of blocks from below and above, and blocks are left
    out that can be neither nearer than a pair already seen nor farther; equal
    vectors are at distance 0, so blocks that may hold some always meet. Rows that
    take part as said above. With fewer than two of them distances are null.
    """
    some = comparable(data).select(F.size("vec").alias("d")).first()
    rows = check_dimensions(comparable(data), some["d"] if some else 0)
    pivots = np.array([r["vec"] for r in rows.orderBy(draw_int("id"), "id").limit(n_pivots).select("vec").collect()], float)
    if not len(pivots):
        return data.sparkSession.createDataFrame([(0, None, None, 0)], "pairs long, min_dist double, max_dist double, equal_pairs long")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(np.array([*b["vec"]], float), pivots, "l2")
                yield b.assign(pivot=d.argmin(axis=1), near=d.min(axis=1))

    # Rows by their nearest pivot and the distance to it lie near one another; equal rows lie side by side.
    near = rows.mapInPandas(placed, "id long, vec array<double>, pivot int, near double").repartitionByRange("pivot", "near", "vec").sortWithinPartitions("pivot", "near", "vec")
    blocks = numbered_blocks(packed(near, EXTREME_BLOCK))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples(index=False):
                d = distances(np.frombuffer(x.matrix).reshape(-1, x.width), pivots, "l2")
                yield pd.DataFrame({"block": [x.block], "low": [d.min(axis=0)], "high": [d.max(axis=0)]})

    reached = kept(blocks.select("block", "matrix", "width").mapInPandas(reach, "block long, low array<double>, high array<double>"))

    def seen(v: np.ndarray, w: np.ndarray, same: bool) -> tuple[int, float, float, int]:
        low, high, equal, n = np.inf, -np.inf, 0, 0
        for at in range(0, len(v), MANY):
            d, off = squares(v[at : at + MANY], w)
            if not same and d.min() > max(off, low * low + 2 * off) and d.max() < high * abs(high) - 2 * off:
                n += d.size  # nothing here that is equal, nearer or farther
                continue
            wanted = np.arange(at, at + len(d))[:, None] < np.arange(len(w))[None, :] if same else np.ones(d.shape, bool)
            if not wanted.any():
                continue
            # Pairs that may be equal, or the nearest or farthest so far, are measured by their differences.
            least, most = np.where(wanted, d, np.inf).min(), np.where(wanted, d, -np.inf).max()
            near = d <= max(off, min(least, low * low) + 2 * off) if np.isfinite(off) else wanted
            r, c = np.nonzero((near | (d >= max(most, high * abs(high)) - 2 * off)) & wanted)
            exact = pair_distances(v[at : at + MANY], w, r, c)
            n += int(wanted.sum())
            if len(exact):
                low, high, equal = min(low, exact.min()), max(high, exact.max()), equal + int((exact == 0).sum())
        return n, low, high, equal

    def row(n, low, high, equal) -> pa.RecordBatch:
        fine = np.isfinite([low])
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low], mask=~fine), pa.array([high], mask=~fine), pa.array([equal])], ["pairs", "low", "high", "equal"])

    step = lambda held, x: row(*seen(held[0], np.frombuffer(x["q_matrix"]).reshape(-1, x["q_width"]), held[2] == x["q_at"]))
    begin = lambda x: (*held_block(x), x["at"])
    held = blocks.withColumn("at", F.col("block"))
    asked = blocks.select(F.col("block").alias("q_block"), F.col("block").alias("q_at"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"))
    schema = "pairs long, low double, high double, equal long"
    within = kept(meet(held, asked, blocks.select("block", F.col("block").alias("q_block")), lambda: (begin, step), schema))
    first = within.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    low, high = first["low"] if first["low"] is not None else float("inf"), first["high"] if first["high"] is not None else -float("inf")
    a, b = (reached.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high"))) for s in "ab")
    both = a.join(b, F.col("block_a") < F.col("block_b"))
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    least, most = F.greatest(F.array_max(gaps), F.lit(0.0)), F.array_min(F.zip_with("high_a", "high_b", lambda x, y: x + y))
    # Either block of a pair may be the one that is held: by turns, so that no task holds those with the most pairs.
    low_, high_ = (F.col(c).bitwiseAND((1 << 33) - 1) + F.shiftrightunsigned(c, 33) for c in ("block_a", "block_b"))
    turned = (low_ + high_) % 2 == 1
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    open_ = both.where((least < low + SLACK) | (most > high - SLACK)).select(pick("block_a", "block_b").alias("block"), pick("block_b", "block_a").alias("q_block"))
    every = within.unionByName(meet(held, asked, kept(open_), lambda: (begin, step), schema))
    return every.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.min("low").alias("min_dist"), F.max("high").alias("max_dist"), F.coalesce(F.sum("equal"), F.lit(0)).alias("equal_pairs"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of true neighbours (qid, id) that were found."""
    hit = truth.select("qid", "id").join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"))


def upsert(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    """id, vec, version: the newest version of each id; of equal ones, the update.

    Of updates that are equal too, the one with the largest vector stays, so that reruns agree.
    """
    all_ = vectors.select("id", "vec", "version", F.lit(0).alias("late")).unionByName(updates.select("id", "vec", "version", F.lit(1).alias("late")))
    top = all_.groupBy("id").agg(F.max(F.struct("version", "late", "vec")).alias("top"))
    return top.select("id", "top.vec", "top.version")


def remove(vectors: DataFrame, removals: DataFrame) -> DataFrame:
    """The rows without those for which a removal (id, version) is at least as new."""
    newest = removals.groupBy("id").agg(F.max("version").alias("gone"))
    return vectors.join(newest, "id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("version"))).drop("gone")


def removal_results(vectors: DataFrame, removals: DataFrame) -> DataFrame:
    """id, version, removed: whether each removal takes effect. Unknown ids and old versions don't."""
    return removals.join(vectors.select("id", F.col("version").alias("have")), "id", "left").select("id", "version", F.coalesce(F.col("version") >= F.col("have"), F.lit(False)).alias("removed"))


def level_histogram(vectors: DataFrame, m: int, max_level: int, seed: int = 0) -> DataFrame:
    """Rows by the level that a hash of their id draws: floor(-ln(u) / ln(m)), at most max_level."""
    u = (draw_int("id", seed=seed) + 1) / F.lit(float(RANGE))
    level = F.least(F.floor(-F.log(u) / F.log(F.lit(float(m)))), F.lit(max_level))
    return vectors.select(level.cast("long").alias("level")).groupBy("level").count()
