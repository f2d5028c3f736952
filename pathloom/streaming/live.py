"""Segmentation and vector tables that follow a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathloom.functions import geo
from pathloom.operators.knn import upsert

SEGMENT = "key long, seg long, start timestamp, end timestamp, n_points long, x1 double, y1 double, x2 double, y2 double, life timestamp"


def live_segments(fixes: DataFrame, gap_seconds: float, delay: str = "0 seconds", forget_seconds: float | None = None) -> DataFrame:
    """Segments of a stream of fixes (key, ts, x, y), each emitted once it has ended.

    A fix ``gap_seconds`` or more after the one before ends a segment, and so does a
    watermark (``delay`` behind the latest time) that far past its last fix. State is
    one segment a key, open or (without points) only the number of the next one.
    With ``forget_seconds`` a key leaves the state when nothing came for so long after
    its last segment ended. If it comes again, numbers begin at 0 in a new ``life``
    (the time of its first fix); ``numbered_segments`` numbers the written segments
    through. Fixes at or before the watermark are dropped.
    """
    gap = pd.Timedelta(seconds=gap_seconds)
    forget = None if forget_seconds is None else pd.Timedelta(seconds=forget_seconds)

    def wake(state: GroupState, at: pd.Timestamp) -> None:
        state.setTimeoutTimestamp(max(int(at.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [0, None, None, 0, 0.0, 0.0, 0.0, 0.0, None]
        done = []
        if state.hasTimedOut:
            if now[3]:
                done.append(now)
                state.update((now[0] + 1, now[1], now[2], 0, *now[4:]))
                if forget is not None:
                    wake(state, pd.Timestamp(now[2]) + gap + forget)
            else:
                state.remove()
        else:
            fresh = pd.concat(list(batches)).sort_values("ts")
            for ts, x, y in zip(fresh["ts"], fresh["x"], fresh["y"], strict=True):
                life = ts if now[8] is None else now[8]
                if now[3] and ts - pd.Timestamp(now[2]) >= gap:
                    done.append(now)
                    now = [now[0] + 1, *now[1:3], 0, *now[4:]]
                if now[3]:
                    now = [now[0], now[1], max(ts, pd.Timestamp(now[2])), now[3] + 1, now[4], now[5], x, y, life]
                else:
                    now = [now[0], ts, ts, 1, x, y, x, y, life]
            state.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in now))
            wake(state, pd.Timestamp(now[2]) + gap)
        if done:
            yield pd.DataFrame([[key[0], *d] for d in done], columns=[c.split()[0] for c in SEGMENT.split(", ")])

    marked = fixes.withWatermark("ts", delay)
    state = SEGMENT.partition(", ")[2]
    out = marked.groupBy("key").applyInPandasWithState(step, SEGMENT, state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("metres", geo.haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def numbered_segments(segments: DataFrame) -> DataFrame:
    """Written segments with seg from 0 through all lives of a key. Later segments of a key never change the numbers of earlier ones."""
    lives = segments.groupBy("key", "life").agg((F.max("seg") + 1).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("key").orderBy("life").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = lives.select("key", "life", ahead.alias("_base"))
    return segments.join(base, ["key", "life"]).withColumn("seg", F.col("seg") + F.col("_base")).select(*segments.columns)


def live_upserts(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds a batch's vectors (id, vec, version) to the table at ``path``.

    A batch writes its own rows alone, the newest of each id, under its number; a
    batch that runs again writes them anew. ``live_vectors`` reads the table.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.limit(0), batch).write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")

    return step


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Finished folders ``name=number`` below ``path``, by number."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(top):
        return {}
    found = [x.getPath() for x in store.listStatus(top)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().partition("=")[2]): p.toString() for p in done}


def _parts(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, str]]]:
    """Up to which batch the table is compacted (-1: none), and its folders that count, with their numbers."""
    bases, batches = _folders(spark, f"{path}/base", "upto"), _folders(spark, f"{path}/batches", "batch")
    upto = max(bases, default=-1)
    return upto, ([(upto, bases[upto])] if bases else []) + sorted((b, p) for b, p in batches.items() if b > upto)


def live_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, vec, version: the newest version of each vector; of equal ones that of the later batch."""
    rows = None
    for number, folder in _parts(spark, path)[1]:
        one = spark.read.parquet(folder).select("id", "vec", "version", F.lit(number).cast("long").alias("batch"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError(f"no batch has been written below {path}")
    top = rows.groupBy("id").agg(F.max(F.struct("version", "batch", "vec")).alias("top"))
    return top.select("id", "top.vec", "top.version")


def compact(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Fold all batches but the last ``keep`` into one folder and delete theirs; the number of the last one folded (-1: none).

    Call it from the job that runs the stream, between batches, or with ``keep`` over
    the batches that may run again. A run that breaks off leaves the table as it was:
    the new folder counts once it is whole, and what is left behind goes next time.
    """
    upto, folders = _parts(spark, path)
    own = [b for b, _ in folders if b > upto]
    last = own[-keep - 1] if len(own) > keep else upto
    if last > upto:
        rows = None
        for number, folder in folders:
            if number <= last:
                one = spark.read.parquet(folder).select("id", "vec", "version", F.lit(number).cast("long").alias("batch"))
                rows = one if rows is None else rows.unionByName(one)
        top = rows.groupBy("id").agg(F.max(F.struct("version", "batch", "vec")).alias("top"))
        top.select("id", "top.vec", "top.version").write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    for number, folder in [*_folders(spark, f"{path}/batches", "batch").items(), *((n + 1, f) for n, f in _folders(spark, f"{path}/base", "upto").items())]:
        if number <= last:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return last
