"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import alignment, divergence, exact_dedup, langid, line_quality, merge_tokens, mixing, near_dup, rules, token_files, topk, url_rules, warc
from pathloom.llm.common import crc_mod3

#: Id that ends each document in token files.
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule failures and measures of every whole text of ``documents``; a null or empty text has no words and fails the base rules; rows that repeat are rows each; an empty table gives no rows."""
    book = rules.ledger(table(spark, sf_dir, "documents"))
    failed = ~rules.passes(rules.BASE)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.passes(rules.STRICT)).alias("kept"), "failures"
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT r, max(n) AS n_top_word FROM (SELECT r, word, count(*) AS n FROM p GROUP BY r, word) GROUP BY r),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n
  FROM (SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE w3 IS NOT NULL
),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT w.doc_id, len(w.words)::BIGINT AS n_words,
    length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(l.n_lines, 0) AS n_lines, coalesce(t.n_top_word, 0) AS n_top_word,
    length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g')) AS n_upper,
    length(w.text) - length(regexp_replace(w.text, '[A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN l USING (r) LEFT JOIN rep USING (r) LEFT JOIN t USING (r)
),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_upper > 50 * n_letters THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_top_word > 30 * n_words THEN 64 ELSE 0 END)::BIGINT AS failures FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``, learnt from labelled rows that aren't held out; null and empty texts have the score of a text without lines; a model without labelled rows as in ``line_quality.train``; rows that repeat are scored each."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_quality.train(docs, labels.where(crc_mod3(F.col("doc_id")) != 1))
    return line_quality.score(docs, model).select("doc_id", (crc_mod3(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies of all ``documents``, by sets of four words; null and empty texts, ids that are null or repeat, and empty tables as in ``near_dup.near_duplicates``."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM d
),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k) UNION SELECT b, a FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
reach AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM link) UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.m, s.doc_id) AS component_id, coalesce(c.m, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c USING (doc_id)
"""


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best scores of each query among all ``embeddings``, ties to the smaller id; vectors that are null or hold null, NaN or infinite components take no part; repeats as in ``topk.top_k``."""
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, rows.where("id % 20 = 0"), 20)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
),
e AS (SELECT vec_id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written as a record and read back through the index; null html is an empty payload; urls that are null, empty or repeat have keys of their own by page."""
    pages = table(spark, sf_dir, "pages")
    index = warc.build_index(warc.write_archives(pages))
    places = warc.lookup(index, pages.select(warc.url_key(F.col("url"), F.col("page_id")).alias("key")))
    return warc.read_records(places, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM m
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix takes of each row of ``documents``; null and empty texts have size 0 and are taken 0 times; a null source is a source, the last; rows without an id count."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source
),
w AS (SELECT *, [5.0, 2.0, 1.0][(no % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS at_most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (
  SELECT *, row_number() OVER z AS i, (budget - coalesce(sum(at_most) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM w WINDOW z AS (ORDER BY at_most / weight, no)
),
u AS (SELECT arg_min(unit, i) AS unit FROM o WHERE unit <= at_most / weight),
t AS (SELECT source, source_size, least(at_most, coalesce(u.unit * weight, at_most)) AS target FROM o LEFT JOIN u ON true),
b AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
x AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.words - b.epochs * b.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM x
"""


def piece_model() -> bytes:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op7_merge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of the decoded text of every whole text of ``documents``; null texts are empty ones, which have no tokens; rows that repeat are encoded each."""
    return merge_tokens.digest_documents(table(spark, sf_dir, "documents"), piece_model())


#: (host, path, verdict) of the rules that op8 applies.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that judges each url of ``pages``; urls that are null or have no host fit no rule; ties and repeated rules as in ``url_rules.judge``."""
    listed = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True))) for r in URL_RULES))))
    return url_rules.judge(table(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
m AS (
  SELECT i, arg_max(rhost || rpath, (length(rhost || rpath), length(rhost))) AS rule, arg_max(v, (length(rhost || rpath), length(rhost))) AS v
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY i
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (i)
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written to token files and read back, in ascending order of ids, null ids first; null and empty texts hold the end id alone; rows of one id follow one another."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), definition, END_ID), with_ids=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learnt from rows that aren't held out; null texts and texts without a letter are ``und`` with score 0; without rows to learn from as in ``langid.predict``."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod3(F.col("doc_id")) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and each source's terms, of all rows of ``documents``; nulls, ties and names as in ``divergence.audit``."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
),
t AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS c FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(c)::BIGINT AS c FROM t GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, sum(t.c)::BIGINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (n.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN n ON n.lang = g.lang AND n.source = g.source JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie over one another in every whole text of ``documents``; nulls, empty texts and repeats as in ``alignment.align``."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return alignment.align(table(spark, sf_dir, "documents"), definition, piece_model())[0]


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all rows of ``documents`` with equal texts stays; nulls, ties and repeated ids as in ``exact_dedup.exact_dedup``."""
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r DESC) = 1 AS kept FROM d)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM w
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_rule_ledger,
        op2_line_quality,
        op3_near_duplicates,
        op4_maxscore,
        op5_warc,
        op6_mixing,
        op7_merge_tokens,
        op8_url_rules,
        op9_token_files,
        op10_language,
        op11_source_divergence,
        op12_token_alignment,
        op13_exact_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_rule_ledger": OP1_SQL,
    "op3_near_duplicates": OP3_SQL,
    "op4_maxscore": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op8_url_rules": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_exact_dedup": OP13_SQL,
}
