"""Exact top-k by inner product with MaxScore.

A component of a query is a term; its product with a candidate's component is
what the term adds. Candidates travel in shards. A shard holds for each term a
posting list, all its candidates' values, with the list's limits. For a query they
give each term's bound in the shard, counted from the least that the term adds to
any candidate there, so that bounds are never negative whatever the signs.

For each query the terms are split by these bounds against the k-th best score so
far, the threshold: the terms with the smallest bounds are *non-essential* as far
as their bounds together don't reach it. The queries of a block walk the essential
lists together: their sums are one product of weights, 0 where a term is
non-essential for a query, and lists. Candidates whose sum and the bounds of the
non-essential terms reach the threshold are probed there, the largest bounds first,
as long as what is left keeps them competitive. Scores that enter raise the
threshold, which goes on to the next shard that the task reads. Shards' results are
merged by a ranked window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import written

VECTORS, QUERIES = 8192, 512
#: Candidates whose scores give a query its first threshold, and postings of a list that queries walk at a time.
FIRST, WALKED = 256, 2048
#: Terms that are probed at a time.
STEP = 8
#: Query blocks whose thresholds a task remembers.
REMEMBERED = 256


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x, taken as double."""
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, not empty, and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


PACKED = "shard int, ids binary, matrix binary, width int, item int"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(id, vector of long) rows as blocks: shard (the partition), ids, matrix, its width and the bytes of a number."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        shard = 0

        def flush(part):
            width = max(len(v) for _, v in part)
            matrix = np.zeros((len(part), width), np.int64)
            for k, (_, v) in enumerate(part):  # a component that is missing is 0
                matrix[k, : len(v)] = v
            small = np.result_type(np.min_scalar_type(min(0, int(matrix.min()))), np.min_scalar_type(min(-1, -int(matrix.max()))))
            ids = np.array([i for i, _ in part], "<i8").tobytes()
            return pd.DataFrame({"shard": [shard], "ids": [ids], "matrix": [matrix.astype(small.newbyteorder("<")).tobytes()], "width": [width], "item": [small.itemsize]})

        for batch in batches:
            for i, v, s in zip(batch["id"], batch["vector"], batch["shard"], strict=True):
                held.append((i, v))
                shard = s
                if len(held) == size:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return rows.withColumn("shard", F.spark_partition_id()).mapInPandas(pack, PACKED)


def unpacked(matrix: bytes, width: int, item: int) -> np.ndarray:
    return np.frombuffer(matrix, f"<i{item}").reshape(-1, width).astype(np.int64)


class Postings:
    """One shard: for each term its candidates' values, and their limits."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.ids = ids
        self.lists = np.ascontiguousarray(vectors.T)  # term x candidate
        self.low, self.high = (f(self.lists, axis=1) if len(ids) else np.zeros(len(self.lists), np.int64) for f in (np.min, np.max))
        self.largest = int(np.abs(vectors).max(initial=0))
        self.kinds: dict[type, np.ndarray] = {}

    def search(self, q: np.ndarray, own: int, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
        """``search_all`` of one query."""
        return self.search_all(q[None], np.array([own]), k, [threshold])[0]

    def search_all(self, qs: np.ndarray, own: np.ndarray, k: int, thresholds: list[int | None]) -> list[tuple[np.ndarray, np.ndarray, int | None]]:
        """For each query ids and scores of the k best candidates that reach its threshold (ties too), and the threshold then.

        Thresholds: no candidate below them is wanted; None before k scores are known.
        """
        most_sum = self.largest * int(np.abs(qs).max(initial=0)) * max(1, qs.shape[1])
        kind = np.float32 if most_sum < 1 << 24 else np.float64 if most_sum < 1 << 53 else np.int64  # all sums are exact
        if kind not in self.kinds:
            self.kinds[kind] = self.lists.astype(kind)
        lists, weights = self.kinds[kind], qs.astype(kind)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), t) for t in thresholds]
        first = weights @ lists[:, :FIRST]
        for i, (ids, scores, t) in enumerate(found):
            if t is None:  # all that is met now is scored again below, where ties with the threshold stay
                others = self.ids[:FIRST] != own[i]
                found[i] = ids, scores, _cut(self.ids[:FIRST][others], first[i][others].astype(np.int64), k, None)[2]
        for a in range(0, len(self.ids), WALKED):
            self._walk(slice(a, a + WALKED), qs, weights, lists, own, k, found)
        return found

    def _walk(self, at: slice, qs: np.ndarray, weights: np.ndarray, lists: np.ndarray, own: np.ndarray, k: int, found: list) -> None:
        """Queries meet a stretch of the essential lists, and what they find goes to ``found``."""
        ids = self.ids[at]
        most, least = np.maximum(qs * self.low, qs * self.high), np.minimum(qs * self.low, qs * self.high)
        bound = most - least
        rising = np.argsort(bound, axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(bound, rising, axis=1), axis=1) + least.sum(axis=1)[:, None]  # with the terms up to each place
        thresholds = np.array([np.iinfo(np.int64).min if t is None else t for _, _, t in found])
        spare = np.empty(bound.shape, bool)
        np.put_along_axis(spare, rising, reach < thresholds[:, None], axis=1)  # non-essential: together they don't reach the threshold
        sums = np.where(spare, weights.dtype.type(0), weights) @ lists[:, at]
        left = np.where(spare, most, 0).sum(axis=1)
        wanted = sums >= np.where(thresholds == np.iinfo(np.int64).min, thresholds, thresholds - left)[:, None]
        wanted &= own[:, None] != ids[None, :]
        for i in np.flatnonzero(wanted.any(axis=1)):
            met = np.flatnonzero(wanted[i])
            score, behind = sums[i, met].astype(np.int64), int(left[i])
            terms = rising[i][spare[i][rising[i]]][::-1]
            for s in range(0, len(terms), STEP):
                part = terms[s : s + STEP]
                score = score + (qs[i, part] @ self.lists[part][:, at][:, met])
                behind -= int(most[i, part].sum())
                keep = score + behind >= thresholds[i]
                met, score = met[keep], score[keep]
            was, scores, t = found[i]
            found[i] = _cut(np.append(was, ids[met]), np.append(scores, score), k, t)


def _cut(ids: np.ndarray, scores: np.ndarray, k: int, threshold: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """The k best, ties to the smaller id, and the k-th score if there are k."""
    if len(scores) > k:
        at = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[at], scores[at]
    if len(scores) >= k:
        kth = int(scores.min())
        threshold = kth if threshold is None else max(kth, threshold)
    return ids, scores, threshold


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates, ties to the smaller id.

    Both tables: id (long), vector (array of long). A candidate with the query's
    id is the query itself and is left out. Null ids or vectors take no part;
    equal rows are candidates each. Vectors may differ in length: a component
    that one lacks is 0. Empty tables give no rows; other columns are not read.
    """
    filled = "id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0"
    shards = written(blocks(vectors.where(filled).select("id", "vector"), VECTORS), "vector-blocks")
    packed = written(blocks(queries.where(filled).select("id", "vector"), QUERIES), "query-blocks")
    last = shards.agg(F.max("shard")).first()[0]
    last = -1 if last is None else last
    # Each query block goes to each shard: the query set is compared with all rows, block by block.
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, last)))).alias("shard"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"), F.col("item").alias("q_item"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[bytes, Postings] | None = None
        known: dict[bytes, list[int | None]] = {}  # thresholds of query blocks: they hold over the shards that follow
        for batch in batches:
            for x in batch.itertuples(index=False):
                if held is None or held[0] != x.ids:
                    held = x.ids, Postings(unpacked(x.matrix, x.width, x.item), np.frombuffer(x.ids, "<i8"))
                own, q = np.frombuffer(x.q_ids, "<i8"), unpacked(x.q_matrix, x.q_width, x.q_item)
                terms = np.zeros((len(q), x.width), np.int64)
                terms[:, : x.q_width] = q[:, : x.width]
                thresholds = known.pop(x.q_ids, None) or [None] * len(q)
                found = held[1].search_all(terms, own, k, thresholds)
                out = [pd.DataFrame({"query_id": np.full(len(ids), own[i]), "vec_id": ids, "score": score}) for i, (ids, score, _) in enumerate(found)]
                known[x.q_ids] = [t for _, _, t in found]
                if len(known) > REMEMBERED:
                    known.pop(next(iter(known)))
                yield pd.concat(out)

    pairs = shards.join(sent, "shard").drop("shard")
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
