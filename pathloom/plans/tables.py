"""The driver's tables as trajectories and vectors, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events: value and k as place, the event's type as keyword."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("tid"), F.col("event_id").alias("pid"), epoch_millis("ts").alias("ts"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.array("event_type").alias("terms")
    )


EVENT_POINTS = "SELECT user_id AS tid, event_id AS pid, epoch_us(ts) // 1000 AS ts, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y, [event_type] AS terms FROM events"


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders: price and day as place, priority and status as keywords."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("tid"),
        F.col("o_orderkey").alias("pid"),
        epoch_millis("o_orderdate").alias("ts"),
        (F.col("o_totalprice") / 1000).alias("x"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("y"),
        F.array("o_orderpriority", "o_orderstatus").alias("terms"),
    )


ORDER_POINTS = (
    "SELECT o_custkey AS tid, o_orderkey AS pid, epoch_us(o_orderdate) // 1000 AS ts, o_totalprice / 1000 AS x, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS y,"
    " [o_orderpriority, o_orderstatus] AS terms FROM orders"
)


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines: price and quantity as place, brand and type of the part as keyword."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    pid = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")).cast("long")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("tid"), pid.alias("pid"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.array(F.concat_ws("/", "p_brand", "p_type")).alias("terms")
    )


LINE_POINTS = (
    "SELECT l_orderkey AS tid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pid,"
    " l_extendedprice AS x, l_quantity AS y, [p_brand || '/' || p_type] AS terms FROM lineitem JOIN part ON l_partkey = p_partkey"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


VECTORS = "SELECT vec_id AS id, embedding AS vec, label FROM embeddings"


def asked(rows: DataFrame, key: str = "tid") -> DataFrame:
    """The query set: all rows whose id is divisible by 20."""
    return rows.where(F.col(key) % 20 == 0)
