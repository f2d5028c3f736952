"""Exact duplicates as a stateful stream, in DataFrame operations alone.

Documents come in as a stream of files. For each digest of a normalised text
(A-Z lower-cased) the stream keeps in its state, on disk (RocksDB) and without
expiry, the row that stays (its id and where its content lies: file and row) and
how many rows have come. A later batch of files, or a later run with the same
``location``, goes on from there and reads new files alone.

Rows are then held against the state. A row that isn't the one that stays is a
hit, and its full text is compared with the content that the state points to, so
the digest may be cut short without any change of the result. Hits whose text
differs (another text with the same digest) are grouped by their text.

Digests that a large share of the rows has are few, so they travel to all tasks
as a table of at most ``HOT`` rows; comparisons of their texts are dealt over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import scratch, written

#: State on disk; a part of it takes the disk that it fills, not what it may fill one day.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A digest with more than one HOT-th of all rows is hot, so there are fewer than HOT.
HOT = 1024
#: Hits of one digest that are compared under one key, at least.
SALT_ROWS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def located(files: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """doc_id, norm, digest and stay (what the state keeps of a row: id, file and row), of rows of a file source."""
    norm = normalised(F.col(text_col))
    stay = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return files.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), F.substring(F.unhex(F.sha2(norm.cast("binary"), 256)), 1, digest_bytes).alias("digest"), stay.alias("stay"))


def absorb(rows: DataFrame, location: str) -> None:
    """Take what is new in a stream of ``located`` rows into the state at ``location``."""
    spark = rows.sparkSession
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        groups = rows.groupBy("digest").agg(F.max("stay").alias("stay"), F.count("*").alias("n"))
        query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", location).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def groups(spark: SparkSession, location: str) -> DataFrame:
    """digest, stay and n of all rows that came in so far, read from the state."""
    return spark.read.format("statestore").load(location).select("key.digest", F.col("value.max").alias("stay"), F.col("value.count").alias("n"))


def matched(rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """``rows`` with stay (as ``kept_row``) and n of their digest, inner; hot digests travel, the others are shuffled."""
    many = max(SALT_ROWS, total // HOT)
    named = known.withColumnRenamed("stay", "kept_row")
    hot = F.broadcast(named.where(F.col("n") > many))  # fewer than HOT rows
    return rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(named.where(F.col("n") <= many), "digest"))


def unequal(rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """digest, stay and norm of the hits whose text is not the one that the state points to."""
    many = max(SALT_ROWS, total // HOT)
    repeats = matched(rows.select("digest", "stay", "norm"), known.where("n > 1"), total).withColumn("salts", F.ceil(F.col("n") / many).cast("long"))
    texts = written(repeats, "repeats")  # read twice below
    is_kept = F.col("stay").eqNullSafe(F.col("kept_row"))
    content = texts.where(is_kept).select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("norm").alias("content"))
    hits = texts.where(~is_kept).select("digest", F.pmod(F.xxhash64("stay"), "salts").alias("salt"), "stay", "norm")
    return hits.join(content, ["digest", "salt"]).where("norm != content").select("digest", "stay", "norm")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", location: str | None = None, digest_bytes: int = 32, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of the Parquet files at ``path`` (a pattern, file or folder).

    Texts are equal if they are the same after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest id stays, of equal ids the one
    that is last by file and place in it; null ids are smallest, and keep_id is
    null where all are null. ``location`` keeps the state: a later call with it
    takes in new files alone; its path must match the earlier files too, unchanged.
    Without it a new folder of the shared one is used. Only the two columns are
    read, so other names don't matter. An empty table gives an empty table.
    """
    location = location or scratch(spark, "exact-dedup")
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    # A stream reads folders or patterns, so the path of a single file is written as a pattern.
    pattern = path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(pattern)
    absorb(located(stream, id_col, text_col, digest_bytes), location)
    known = written(groups(spark, location), "groups")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    rows = located(spark.read.schema(schema).parquet(path), id_col, text_col, digest_bytes)
    odd = written(unequal(rows, known, total), "unequal")
    marked = matched(rows.select("doc_id", "digest", "stay", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), known, total)
    if not odd.isEmpty():
        # Different texts of one digest: those that aren't the kept row's are grouped by themselves.
        own = odd.groupBy("digest", "norm").agg(F.max("stay").alias("own_row"), F.count("*").alias("own_n"))
        own = odd.join(own, ["digest", "norm"]).select("stay", "own_row", "own_n")
        fewer = odd.groupBy("digest").agg(F.count("*").alias("gone"))
        marked = marked.join(fewer, "digest", "left").join(own, "stay", "left").withColumns(
            {"kept_row": F.coalesce("own_row", "kept_row"), "n": F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0)))}
        )
    return marked.select("doc_id", F.col("kept_row.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("stay").eqNullSafe(F.col("kept_row")).alias("kept"), "text_sha256")
