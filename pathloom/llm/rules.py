"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for every document. The ledger keeps what was
measured and a bit for each rule that failed; policies (a name, a version and a
set of rules) and ablations are then bitwise work on the ledger alone, without
the texts.

Words are runs of ``[^\\x20\\x09-\\x0D]``. A null text has no words and fails
what an empty one fails; no row is dropped, and equal rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import per_batch

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_top_word")
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measures; ``bit`` is the rule's place for good."""

    name: str
    bit: int
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    """A document passes if it fails none of ``rules``."""

    name: str
    version: int
    rules: tuple[str, ...]


def _c(name: str) -> Column:
    return F.col(name)


RULES = (
    Rule("few_words", 0, lambda: _c("n_words") < 50),
    Rule("repeated_words", 1, lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule("symbols", 2, lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("repeated_lines", 3, lambda: 100 * _c("n_dup_lines") > 50 * _c("n_lines")),
    Rule("word_length", 4, lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 12 * _c("n_words"))),
    Rule("upper_case", 5, lambda: 100 * _c("n_upper") > 50 * _c("n_letters")),
    Rule("one_word", 6, lambda: 100 * _c("n_top_word") > 30 * _c("n_words")),
)
BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    n = len(words)
    code: dict[bytes, int] = {}
    codes = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    repeated = 0
    if n > 3:
        pairs = np.unique(codes[:-2] * len(code) + codes[1:-1], return_inverse=True)[1]
        _, which, times = np.unique(pairs * len(code) + codes[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= again
        repeated = int(inside.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = upper + len(raw) - len(raw.translate(None, LOWER))
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        upper,
        letters,
        int(np.bincount(codes).max()) if n else 0,
    )


def measure_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and MEASURES (long) of every row's whole text."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([measure(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(MEASURES))
            return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c) for c in found.T)], schema.names)

        return work

    return per_batch(rows, make, schema)


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def ledger(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measures and ``failures``: a bit for each rule that fails.

    Ids may be null or repeat: rows stay apart. Only the two columns are read, so
    other names don't matter, and an empty table gives an empty table.
    """
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure_documents(df, id_col, text_col).withColumn("failures", bits)


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy, what it does alone and within the policy.

    One aggregation of the ledger by failure pattern (at most 2 ** rules rows),
    then bitwise counts: documents and words that fail the rule, and those that
    only this rule rejects, which would come back without it.
    """
    patterns = book.groupBy("failures").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"))
    whole = F.lit(mask(policy, rules)).cast("long")
    of = {r.name: r.bit for r in rules}
    listed = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << of[n]).cast("long").alias("bit")) for n in policy.rules))
    each = patterns.select("failures", "docs", "words", F.explode(listed).alias("r"))
    fails = F.col("failures").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("failures").bitwiseAND(whole) == F.col("r.bit")
    count = lambda cond, what: F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0).cast("long"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(fails, "docs").alias("failed_docs"),
        count(fails, "words").alias("failed_words"),
        count(alone, "docs").alias("only_docs"),
        count(alone, "words").alias("only_words"),
    )
