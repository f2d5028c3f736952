"""URL filters as a sort-merge range join, in DataFrame operations alone.

A URL's key is its host with the labels reversed, each ended by a border, then a
mark and the path; with , for the border and ) for the mark, ``org,example,www,)/en/12``.
Border and mark are control characters, which are escaped where a host has them, so
no host can forge them. A host with everything under it is the interval of keys that
begin with ``org,example,``, and a rule's path below its host the interval of those
with ``org,example,)/en/``. Intervals of prefixes nest or are disjoint.

A sweep sorts keys together with the starts and ends of intervals. Each start
carries the stack of intervals that are open from there on, itself innermost, and
each end the stack that is left; the last mark before a key has the stack of all
intervals that the key lies in. The first sweep finds for each URL the hosts with
rules that it is under, the second, over the same path below each of these, the
rules that fit.

Keys are dealt to as many sweeps as hold about SWEEP_KEYS keys (or as many as
there are marks, if those are more), by a hash of the whole row, and each sweep
gets all marks. So no border cuts a stack, no host is one task's work, and the
marks that are sent number no more than the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import written

#: Keys of a sweep, at least.
SWEEP_KEYS = 4096
#: Ends a label; begins what stands for a border (a) or itself (b) in a host; is between host and path.
BORDER, ESCAPE = "\x01", "\x02"
MARK = f"{ESCAPE}c"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_prefix(host: Column) -> Column:
    """What the keys of a host and of all hosts under it begin with."""
    plain = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(f"{ESCAPE}b")), F.lit(BORDER), F.lit(f"{ESCAPE}a"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), BORDER), F.lit(BORDER))


def stacks(intervals: DataFrame) -> DataFrame:
    """prefix and stack of (prefix, entry): the entries of all intervals that hold this one, innermost first.

    Of each prefix, those beginnings that are as long as some interval's prefix
    are looked up; there are no more of them than it has characters.
    """
    lengths = intervals.select(F.length("prefix").alias("n")).distinct()
    outer = intervals.withColumnsRenamed({"prefix": "start"})
    starts = intervals.select("prefix").join(lengths, F.col("n") <= F.length("prefix")).withColumn("start", F.substring(F.col("prefix"), F.lit(1), F.col("n")))
    held = starts.join(outer, "start").groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "entry"))).alias("held"))
    return held.select("prefix", F.transform("held", lambda x: x["entry"]).alias("stack"))


def swept(keys: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows of ``keys`` that lie in an interval, with ``stack``: the entries of these intervals, innermost first.

    ``keys``: key and other columns; ``intervals``: prefix (each once) and entry.
    """
    nested = written(stacks(intervals), "stacks")
    keys = written(keys, "keys")
    marks, n = 2 * nested.count(), keys.count()
    sweeps = -(-n // max(SWEEP_KEYS, marks)) or 1
    begin, own = F.col("prefix").cast("binary"), [c for c in keys.columns if c != "key"]
    none = [F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in own]
    # 0xFF is in no UTF-8 text: as an end it stands behind all keys with the prefix, and inner ends before outer ones.
    ends = nested.select(F.concat(begin, F.lit(b"\xff")).alias("at"), F.slice("stack", 2, F.size("stack")).alias("open"))
    each = nested.select(begin.alias("at"), F.col("stack").alias("open")).union(ends)
    dealt = each.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long"))).alias("sweep"), "at", F.lit(0).alias("kind"), "open", *none)
    rows = keys.select(F.pmod(F.xxhash64("key", *own), F.lit(sweeps)).alias("sweep"), F.col("key").cast("binary").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(dealt.schema["open"].dataType).alias("open"), *own)
    order = W.partitionBy("sweep").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    carried = dealt.union(rows).withColumn("stack", F.last("open", ignorenulls=True).over(order))
    return carried.where("kind = 1 AND size(stack) > 0").select(*own, "stack")


def judge(df: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """The rows of ``df`` with host, path, rule (null if none fits) and verdict.

    ``rules``: host, path, verdict; those with a null or empty host or a null path
    fit nothing. The longest rule wins, by the characters of host and path together, of
    equally long ones that with the longer host; of equal rules a block wins over an
    allow. Columns of ``df`` that
    have one of the four names give way. Rows with null, empty or repeated URLs
    are judged like all others, and all rows stay. Without rules, or for an empty
    table, no rule fits any row.
    """
    named = rules.where("host != '' AND path IS NOT NULL").groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    of_host = F.length("host")
    below = named.select(host_prefix(F.col("host")).alias("host_key"), "path", F.struct((of_host + F.length("path")).alias("n"), of_host.alias("of_host"), F.concat("host", "path").alias("rule"), "verdict").alias("entry"))
    below = written(below, "rules")

    host, path = url_parts(df[url_col])
    rows = df.drop("rule", "verdict") if url_col in ("host", "path") else df.drop("host", "path", "rule", "verdict")
    rows = rows.withColumns({"host": host, "path": path})
    named_rows = rows.where("host != ''")

    # Each distinct URL is judged once.
    urls = named_rows.select("host", "path").distinct().select(F.concat(host_prefix(F.col("host")), F.lit(MARK), F.col("path")).alias("key"), "host", "path")
    under = swept(urls, below.select(F.col("host_key").alias("prefix"), F.col("host_key").alias("entry")).distinct())
    paths = under.select("host", "path", F.explode("stack").alias("host_key")).select(F.concat("host_key", F.lit(MARK), F.col("path")).alias("key"), "host", "path")
    fitting = swept(paths, below.select(F.concat("host_key", F.lit(MARK), F.col("path")).alias("prefix"), "entry"))
    top = fitting.select("host", "path", F.col("stack")[0].alias("top"))  # the longest path of each host that the URL is under
    found = top.groupBy("host", "path").agg(F.max_by("top", F.struct("top.n", "top.of_host")).alias("best")).select("host", "path", "best.rule", "best.verdict")

    judged = named_rows.join(found, ["host", "path"], "left").select(*rows.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    # URLs without a host share one key, so they stay out of the join.
    return judged.unionByName(rows.where("host = ''").select(*rows.columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
