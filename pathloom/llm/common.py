"""Helpers shared by the training-data operators.

Text is cut into words on ASCII white space alone (``[^\\x20\\x09-\\x0D]+``).
On UTF-8 bytes that is ``bytes.split()``, which is how the helpers do it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.plans.storage import scratch

#: Rows that ``per_batch`` works on at a time.
AT_ONCE = 1024


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends, lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` with state that each task makes once, before its first batch.

    At most ``AT_ONCE`` rows are worked on at a time, which bounds what a task holds;
    what Arrow has set free goes back to the system after each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield work(batch.slice(at, AT_ONCE))
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


class Kept(dict):
    """Results by key, made when first asked for. Beyond ``entries``, those not asked for lately go.

    Keys longer than ``longest`` (if given) are worked out each time, so that the
    entries are bounded in size as well as in number.
    """

    def __init__(self, make: Callable, entries: int, longest: int | None = None) -> None:
        self.make, self.entries, self.longest, self.older = make, entries, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as remainder 1 (held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(1))


def out_stream(uri: str):
    """Binary stream to a new file of any store that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # bytes as given, whatever the name


def in_file(uri: str):
    """Random-access reader of a file of any store that Arrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def labelled_sample(rows: DataFrame, label_col: str, per_label: int, seed: int = 0) -> DataFrame:
    """About ``per_label`` rows of each label (null labels take no part), the same ones every time.

    ``rows`` must have ``doc_id``. One small aggregation counts the labels; a hash
    of the id then decides, so that nothing is sorted or gathered.
    """
    label = F.col(label_col)
    counts = rows.where(label.isNotNull()).groupBy(label_col).count().collect()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    wanted = F.lit(False)
    for value, n in counts:
        wanted = wanted | ((label == F.lit(value)) & (draw < F.lit(int(min(1.0, per_label / n) * (1 << 30)))))
    return rows.where(wanted)
