"""Queries over whole tables: the same rows as SQL, as the libraries, or held-out accuracy."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import near_dup, rules
from pathloom.llm.queries import END_ID, ORACLE_SQL, QUERIES, piece_model
from tests.sql import SF, spark_rows, sql_rows

MORE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(ORACLE_SQL[name])


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_merge_tokens_as_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    found = {r["doc_id"]: r for r in QUERIES["op7_merge_tokens"](spark, SF).collect()}
    assert len(found) == len(texts)
    for doc_id, text, _ in texts:
        ids = library.encode(text)
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_token_files_as_the_library(spark, texts):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, start = [], 0
    for doc_id, text, _ in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, END_ID]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op9_token_files"](spark, SF).collect())) == expected


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    both = QUERIES["op10_language"](spark, MORE).where("held_out").join(docs, "doc_id")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert both.agg(F.avg(F.col("rejected").cast("double"))).first()[0] < 0.05


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").where("quality IS NOT NULL")
    both = QUERIES["op2_line_quality"](spark, MORE).where("held_out").join(labels, "doc_id")
    assert both.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.85


def words(text, n):
    found = text.encode().lower().split()
    return {tuple(found[k : k + n]) for k in range(max(1, len(found) - n + 1))} if found else set()


def test_near_duplicates_by_brute_force(spark):
    """Chains of edits, stars whose rim is linked, and one large group, with five words a shingle."""
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 5000, 150)]
        for _ in range(8):
            rows.append((n, " ".join(base)))
            n += 1
            base = list(base)
            at = int(rng.integers(0, 145))
            base[at : at + int(rng.integers(1, 12))] = [f"x{k}" for k in rng.integers(0, 5000, 3)]
    rows += [(n + k, "one text that many documents share word by word in full") for k in range(50)]
    sets = [words(t, 5) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: find(k) for k in range(len(rows))}


def test_ablations(spark):
    book = QUERIES["op1_rule_ledger"](spark, SF).cache()
    rows = book.collect()
    whole = rules.mask(rules.STRICT)
    for r in rules.ablations(book, rules.STRICT).collect():
        bit = next(1 << x.bit for x in rules.RULES if x.name == r["rule"])
        assert r["failed_docs"] == sum(1 for x in rows if x["failures"] & bit)
        assert r["only_docs"] == sum(1 for x in rows if x["failures"] & whole == bit)
        assert r["only_words"] == sum(x["n_words"] for x in rows if x["failures"] & whole == bit)


def test_which_rows_stages_keep(spark, tmp_path):
    """Near duplicates by brute force and the mix by its SQL, each on the rows that the stages before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    predicted = QUERIES["op10_language"](spark, SF)
    assert ids["language"] == sorted(r["doc_id"] for r in predicted.where("NOT rejected").collect())
    good = spark.read.parquet(str(tmp_path / "quality"))
    rows = sorted((r["doc_id"], words(r["text"], 5)) for r in good.select("doc_id", "text").collect())
    label = {k: k for k, _ in rows}
    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            common = len(x & y)
            if x and 100 * common >= 80 * (len(x) + len(y) - common) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    assert ids["near_duplicates"] == sorted(k for k, v in label.items() if k == v)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/near_duplicates/*.parquet'")
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op6_mixing']})").fetchall()
    assert ids["mixing"] == sorted(d for d, size, n in taken if n for _ in range(-(-n // size)))


def test_pipeline(spark):
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows
    for r in rows:
        ids = library.encode(documents[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
