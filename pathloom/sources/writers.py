"""Writers: trajectories, query files, result lines, metrics and vector tables, with point lookups in these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_gps_lines(points: DataFrame, path: str, max_id: int | None = None) -> None:
    """``id,t,x,y`` lines of points (tid, ts, x, y) in order of trajectory and time, of ids up to ``max_id`` if given."""
    rows = points if max_id is None else points.where(F.col("tid") <= max_id)
    rows.select("tid", "ts", "x", "y").repartitionByRange("tid").sortWithinPartitions("tid", "ts").write.mode("append").csv(path)


def write_queries(points: DataFrame, ids: DataFrame, path: str) -> None:
    """The points of the trajectories in ``ids`` (tid), as tab-separated lines that ``read_points_tsv`` reads."""
    chosen = points.join(ids.select("tid").distinct(), "tid", "left_semi")
    chosen.repartitionByRange("tid").sortWithinPartitions("tid", "pid").select("tid", "ts", "x", "y", F.array_join("terms", ",")).write.csv(path, sep="\t", quote="")


def result_lines(results: DataFrame) -> DataFrame:
    """qid and a printable line for each result: id in 7 places and similarity with 5 decimals."""
    return results.select("qid", "rank", F.format_string("%7d %.5f", "tid", "sim").alias("line"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Adds rows of metrics to JSON lines at ``path``, in as many files as there are tasks."""
    metrics.write.mode("append").json(path)


def write_table(vectors: DataFrame, path: str, keys: int = 0) -> None:
    """A vector table as Parquet; with ``keys``, in so many folders by id (``bucket``), sorted, for ``get`` and ``contains``.

    Rows without an id lie in a folder of their own. Each folder is one file, whose
    row groups hold ranges of ids.
    """
    if not keys:
        vectors.write.mode("overwrite").parquet(path)
        return
    dealt = vectors.withColumn("bucket", F.pmod(F.col("id"), F.lit(keys)).cast("int")).repartition(keys, "bucket").sortWithinPartitions("bucket", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def get(spark: SparkSession, path: str, ids: list[int], keys: int) -> DataFrame:
    """The rows with these ids of a table that ``write_table`` wrote with ``keys``: only their folders are opened, and in them only row groups that may hold them."""
    wanted = sorted({i % keys for i in ids})
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("id").isin(ids)).drop("bucket")


def contains(spark: SparkSession, path: str, id_: int, keys: int) -> bool:
    """Whether a table that ``write_table`` wrote with ``keys`` has the id."""
    return not get(spark, path, [id_], keys).select("id").isEmpty()
