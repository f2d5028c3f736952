"""A training corpus from raw documents: five stages, each a written table that the next one reads.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept. The models of the first two are fitted on bounded samples: of the rows
at hand for language, of labelled rows for quality.

=================  =============================================================
language           drops texts whose language is rejected (null, no letters, or
                   a calibrated probability under the threshold)
quality            drops documents that the line model predicts as bad
near_duplicates    keeps one text of each group (five words, similarity 0.8);
                   different texts of one id are texts each
mixing             takes rows by the budgets of their sources, those without an id
                   too: none that got no words, and one for each epoch in which
                   it is taken
tokens             encodes and decodes every text; returns one row a document
=================  =============================================================

The first four return the columns of their input. Null and empty texts end in the
first stage; extra columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import langid, line_quality, merge_tokens, mixing, near_dup
from pathloom.llm.common import crc_mod3, written

#: SQL can express neither the two models nor the encoding.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text's language is rejected; null texts and texts without letters are. Ids may be null or repeat; an empty table stays empty."""
    return langid.keep_identified(docs, langid.train(docs.where(crc_mod3(F.col("doc_id")) != 1)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text is predicted to be bad, by a model learnt from the labelled rows at hand that aren't held out. A null id counts as held out; null texts, and models without labels, as in ``line_quality``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod3(F.col("doc_id")) != 1)
    return line_quality.keep_good(docs, line_quality.train(docs, labels))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows of one id with other texts are texts of their own, equal rows are one, and rows without an id stay, for they can't be named. Texts without words are alike to none."""
    # Texts are compared, not ids: rows of one id and one text are one document, another text of that id is another.
    # Numbers follow ids and then hashes of texts, so that reruns keep the same. A null id can't be compared and stays.
    row, text, own, hashed, kept_row = (unused(docs, x) for x in ("row_no", "text_hash", "own_id", "own_hash", "kept_row"))
    named = docs.where("doc_id IS NOT NULL").withColumn(text, F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    keys = named.select(F.col("doc_id").alias(own), F.col(text).alias(hashed)).distinct().orderBy(own, hashed)
    keys = written(keys.withColumn(row, F.monotonically_increasing_id()), "keys")
    # Both steps deal texts by the same columns, so they are shuffled once.
    once = named.dropDuplicates(["doc_id", text])
    rows = written(once.join(keys, (F.col("doc_id") == F.col(own)) & (F.col(text) == F.col(hashed))).drop(text, own, hashed), "rows")
    kept = near_dup.near_duplicates(rows, id_col=row).where("kept").select(F.col("doc_id").alias(kept_row))
    return rows.join(kept, F.col(row) == F.col(kept_row), "left_semi").drop(row).unionByName(docs.where("doc_id IS NULL"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the budgets of their sources, once for each epoch that takes them; those without words go. A null source is a source of its own; ids may be null or repeat."""
    row, own, times, epoch = (unused(docs, x) for x in ("row_no", "taken_row", "epochs", "epoch"))
    # Each row is taken by its own share of the budget: ids may be null or repeat, so rows are numbered.
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mixing.mix(numbered, row_col=row).where("taken > 0")
    rounds = taken.select(F.col("row").alias(own), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    rows = numbered.join(rounds, F.col(row) == F.col(own))
    return rows.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, own, times, epoch)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, a row for each row of ``docs``; null texts count as empty ones."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return merge_tokens.digest_documents(docs, f.read())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixed), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
