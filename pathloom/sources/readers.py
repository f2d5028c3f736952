"""Readers: point logs, GPS folders, vectors, keyword lists and retrieval truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.keywords import split_terms

POINT = "tid long, pid long, ts long, x double, y double, terms array<string>"


def line_numbers(rows: DataFrame, name: str = "line", each_file: bool = False) -> DataFrame:
    """The rows of a file source with their number: from 0, dense, in the order of paths and of lines in them.

    ``rows`` come straight from ``spark.read``. Rows of each part of a file are
    counted, the counts are summed up over parts (in order of path and offset), and a
    row's number is the sum ahead of its part plus its place in it. So files are read
    twice, but no rows are shuffled or sorted. With ``each_file`` numbers begin anew
    in each file.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    parts = at.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = (W.partitionBy("_path").orderBy("_start") if each_file else W.orderBy("_path", "_start")).rowsBetween(W.unboundedPreceding, -1)  # one row a part
    ahead = parts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return at.join(ahead, ["_path", "_start"]).select(*rows.columns, (F.col("_ahead") + F.col("_id") - F.col("_first")).alias(name))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0 over all files, dense), value: the lines of text files; empty lines count."""
    return line_numbers(spark.read.text(path)).select("line", "value")


def read_points_tsv(spark: SparkSession, path: str, has_timestamp: bool = True) -> DataFrame:
    """Tab-separated points: tid, ts (epoch ms), x, y, keywords; ts may be absent from the file.

    ``pid`` is the number of the line among all lines that aren't empty, so it
    orders the points of a trajectory as they stand in the files. A field that can't
    be read is null.
    """
    ts = "ts long, " if has_timestamp else ""
    rows = line_numbers(spark.read.csv(path, sep="\t", schema=f"tid long, {ts}x double, y double, kws string", quote=""), "pid")
    if not has_timestamp:
        rows = rows.withColumn("ts", F.lit(None).cast("long"))
    return rows.select("tid", "pid", "ts", "x", "y", split_terms(F.col("kws")).alias("terms"))


def by_position(points: DataFrame, length: int) -> DataFrame:
    """tid, pts: every ``length`` points that follow one another by pid (dense, from 0) as a trajectory, with the tid of its first.

    For files in which trajectories have one length and follow one another, whatever
    their ids; the last one may be shorter.
    """
    fields = ["pid", *(c for c in ("ts", "x", "y", "terms") if c in points.columns)]
    place = F.floor(F.col("pid") / length).alias("_place")
    return points.groupBy(place).agg(F.min_by("tid", "pid").alias("tid"), F.array_sort(F.collect_list(F.struct(*fields))).alias("pts")).select("tid", "pts")


def read_gps_folder(spark: SparkSession, folder: str) -> DataFrame:
    """GPS fixes ``id,yyyy-MM-dd HH:mm:ss,x,y`` of all files below a folder: file, line, obj_id, ts, x, y.

    A date that can't be read is null, and the fix takes no part in segmentation.
    """
    rows = spark.read.option("recursiveFileLookup", True).csv(folder, schema="obj_id long, time string, x double, y double").withColumn("file", F.col("_metadata.file_path"))
    return line_numbers(rows, each_file=True).select(
        "file", "line", "obj_id", F.try_to_timestamp("time", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), "x", "y"
    )


def read_vectors(spark: SparkSession, path: str, sep: str = ",", skip_first: bool = False) -> DataFrame:
    """One vector a line; ``skip_first`` leaves out a leading token (word-vector text files), kept as ``name``."""
    parts = F.split(F.trim("value"), f"\\Q{sep}\\E")
    numbers = F.slice(parts, 2, F.size(parts)) if skip_first else parts
    vec = F.transform(numbers, lambda x: x.try_cast("double"))
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.monotonically_increasing_id().alias("id"), *([parts[0].alias("name")] if skip_first else []), vec.alias("vec"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """One keyword a line, trimmed, with its place as term_id."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("term_id"), F.trim("value").alias("term"))
    return rows.where(F.col("term") != "")


def read_ground_truth(spark: SparkSession, path: str, n_queries: int = 100) -> DataFrame:
    """Retrieval truth as (qid, ds_size, rank, tid).

    The file has a line of data-set sizes, ``n_queries`` lines with a query id each,
    then for each query and size a line of ``tid,score`` pairs. It is read as one
    row: its size is the number of queries times sizes times k, whatever the data.
    """
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    sizes = F.transform(F.split(F.trim(F.col("l")[0]), r"[\s,]+"), lambda x: x.cast("long"))
    ids = F.transform(F.slice("l", 2, n_queries), lambda x: F.trim(x).cast("long"))
    lists = lines.select(sizes.alias("sizes"), ids.alias("ids"), F.posexplode(F.slice("l", n_queries + 2, F.size("l"))).alias("at", "line"))
    each = lists.select(
        F.get("ids", F.floor(F.col("at") / F.size("sizes")).cast("int")).alias("qid"), F.get("sizes", (F.col("at") % F.size("sizes")).cast("int")).alias("ds_size"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("p", "pair")
    )
    return each.select("qid", "ds_size", (F.col("p") + 1).alias("rank"), F.split("pair", ",")[0].cast("long").alias("tid"))


def extent(points: DataFrame) -> DataFrame:
    """One row: min and max of ts, x and y."""
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in ("ts", "x", "y") for n, f in (("min", F.min), ("max", F.max))))


def paired(sampled: DataFrame, complete: DataFrame) -> DataFrame:
    """Sampled and complete trajectories (tid, pts) side by side: tid, sampled, complete.

    Both must have the same ids; one that is in a single table is an error.
    """
    both = sampled.select("tid", F.col("pts").alias("sampled")).join(complete.select("tid", F.col("pts").alias("complete")), "tid", "full")
    alone = F.col("sampled").isNull() | F.col("complete").isNull()
    message = F.concat(F.lit("trajectory in one table only: "), F.col("tid").cast("string"))
    return both.withColumn("tid", F.when(alone, F.raise_error(message).cast("long")).otherwise(F.col("tid")))
