"""Every operator and stage on odd rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing names."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import langid, line_quality, merge_tokens, mixing, near_dup, rules, token_files, topk, url_rules, warc
from pathloom.llm.queries import END_ID, piece_model

LONG = "the river runs past the old mill and down to the sea. " * 4000
DOCS = [
    (1, "The cat sat on the mat.\nIt was warm and it slept.", "en", "web"),
    (2, None, "en", "web"),
    (3, "", None, None),
    (4, LONG, "en", "book"),
    (5, LONG, "en", "book"),
    (6, "  \n\t ", "de", "web"),
    (7, "Der Hund lief über die Straße und bellte laut.", "de", "web"),
    (7, "Der Hund lief über die Straße und bellte laut.", "de", "web"),
    (None, "no id here but some words", "en", None),
    (8, "12345 !!! ###", "fr", "zz"),
    (9, "one two three", "en", "web"),
    (10, "ONE two THREE", "en", "web"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASH = ("id", "node", "label", "size", "key", "range", "score", "rank", "print", "start", "bucket", "taken", "rule", "verdict", "host", "path", "kept_id", "taken_id", "epochs", "epoch", "part", "shard")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def language_model():
    return langid.fit(["the cat and the dog sat"] * 20 + ["der hund und die katze"] * 20, ["en"] * 20 + ["de"] * 20)


@pytest.fixture(scope="module")
def quality_model():
    return line_quality.fit(["A good line of words.\nAnother good line here."] * 20 + ["### $$$ ###\n### $$$"] * 20, [1] * 20 + [0] * 20)


def by_id(rows, name):
    return {r["doc_id"]: r[name] for r in rows}


def test_rules(docs, empty):
    rows = rules.ledger(docs).collect()
    assert len(rows) == len(DOCS)
    n = by_id(rows, "n_words")
    assert (n[2], n[3], n[6], n[9], n[None]) == (0, 0, 0, 3, 6)
    assert n[4] == len(LONG.split())
    assert rules.ledger(empty).count() == 0


def test_language(docs, empty, language_model):
    rows = langid.predict(docs, language_model).collect()
    assert len(rows) == len(DOCS)
    lang = by_id(rows, "lang_pred")
    assert lang[2] == lang[3] == lang[6] == lang[8] == "und"
    assert lang[4] == "en" and lang[7] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = langid.keep_identified(docs, language_model)
    assert kept.columns == docs.columns
    assert not {2, 3, 6, 8} & {r["doc_id"] for r in kept.collect()}
    assert langid.predict(empty, language_model).count() == 0
    assert langid.train(empty).labels == []


def test_quality(docs, empty, quality_model, spark):
    rows = line_quality.score(docs, quality_model).collect()
    assert len(rows) == len(DOCS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 6)}) == 1
    assert line_quality.keep_good(empty, quality_model).columns == docs.columns
    none = line_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.scores(["x", None]).tolist() == [0.5, 0.5]


def test_near_duplicates(docs, empty):
    rows = near_dup.near_duplicates(docs, shingle=4).collect()
    assert len(rows) == len(DOCS)
    component = by_id(rows, "component_id")
    assert component[4] == component[5] == 4
    assert component[9] == component[10] == 9  # fewer words than a shingle, equal in lower case
    assert [component[k] for k in (1, 2, 3, 6, 7, 8, None)] == [1, 2, 3, 6, 7, 8, None]
    assert {r["doc_id"] for r in rows if not r["kept"]} == {5, 10}
    assert near_dup.near_duplicates(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS)
    for source in {r["source"] for r in rows}:
        of = [r for r in rows if r["source"] == source]
        assert sum(r["size"] for r in of) == of[0]["source_size"]
        assert sum(r["taken"] for r in of) == round(of[0]["target"])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in of)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0


def test_merge_tokens(docs, empty):
    import hashlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    rows = merge_tokens.digest_documents(docs, piece_model()).collect()
    assert len(rows) == len(DOCS)
    texts = {d[0]: d[1] or "" for d in DOCS}
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert merge_tokens.digest_documents(empty, piece_model()).count() == 0
    assert merge_tokens.encode_documents(docs, piece_model()).where("doc_id = 2 AND n_tokens = 0 AND decoded = ''").count() == 1


def test_token_files(docs, empty):
    import zlib

    import numpy as np
    import tokenizers

    library = tokenizers.Tokenizer.from_str(definition())
    expected, start = [], 0
    for doc_id, text, *_ in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, END_ID]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    found = token_files.read_token_files(token_files.write_token_files(docs, definition(), END_ID)).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    assert token_files.read_token_files(token_files.write_token_files(empty, definition(), END_ID)).count() == 0


PAGES = [
    (1, "http://a.org/x", "q" * 1200),
    (2, "http://b.org/x", "q" * 1200),
    (3, None, "é" * 500),
    (4, "http://A.org/x\r\ny", "é" * 500),
    (5, "no scheme", None),
    (6, "http://a.org/x", ""),
    (7, "http://a.org/x", "short"),
    (8, "http://a.org/x", "short"),
    (None, "http://c.org/", "q" * 1200),
    (9, "http://d.org/", "z" * 300_000),
]


def test_warc(spark):
    import hashlib

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH})
    captures = warc.write_archives(pages)
    index = warc.build_index(captures)
    places = warc.lookup(index, pages.select(warc.url_key(F.col("url"), F.col("page_id")).alias("key")))
    rows = {r["page_id"]: r for r in warc.read_records(places).collect()}
    assert len(rows) == len(PAGES)
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        r = rows[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else raw)
    assert {k: r["refers_to"] for k, r in rows.items() if r["record_type"] == "revisit"} == {1: 2, 3: 4, None: 2}
    assert warc.lookup(index, spark.createDataFrame([("zz,none)/ 1",)], "key string")).count() == 0
    nothing = pages.where("false")
    again = warc.lookup(warc.build_index(warc.write_archives(nothing)), nothing.select(F.col("url").alias("key")))
    assert warc.read_records(again).count() == 0


def test_index_blocks_hold_equal_keys(spark):
    """A key that fills several blocks is found whole."""
    captures = spark.createDataFrame([(f"k{n // 900:03}", "f", n, 1) for n in range(2700)], "key string, file string, offset long, length long")
    found = warc.lookup(warc.build_index(captures), spark.createDataFrame([("k001",), ("k001",), ("none",)], "key string"))
    assert sorted(r["offset"] for r in found.collect()) == list(range(900, 1800))


URLS = ["http://example.org/es/a", "http://www.Example.org/en/12", "http://example.org/x", "https://a.com/fr/x?q#f", "http://com/de/", "http://acom/de/", "http://example.org", None, "", "mail:x", "http://org/", "http://example.org/es/a"]


def brute(url, listed, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.lower()
    fits = [r for r in listed if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (r[0].count("."), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_url_rules(spark):
    listed = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/", "allow"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "", "allow")]
    more = [f"http://h{k % 7}.example.org/e{'sn'[k % 2]}/{k % 30}" for k in range(700)]
    pages = spark.createDataFrame(list(enumerate(URLS + more)), "page_id long, url string").withColumns({c: F.lit("x") for c in CLASH if c not in ("url",)})
    table = spark.createDataFrame(listed, "host string, path string, verdict string")
    rows = url_rules.judge(pages, table).collect()
    assert len(rows) == len(URLS + more)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], listed)
    assert url_rules.judge(pages.where("false"), table).count() == 0
    bare = url_rules.judge(pages, table.where("false")).collect()
    assert len(bare) == len(rows) and all(r["rule"] is None and r["verdict"] == "allow" for r in bare)


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 9, (400, 6))
    vectors[50:90] = vectors[50]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [1] * 6), (999, None), (998, [])], "id long, vector array<long>").withColumn("shard", F.lit(7))
    queries = rows.where("id % 20 = 0")
    got = topk.top_k(rows, queries, 20).collect()
    for q in range(0, 400, 20):
        score = vectors @ vectors[q]
        best = sorted((-int(score[i]), i) for i in range(400) if i != q)[:20]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]
    assert topk.top_k(rows.where("false"), queries).count() == 0
    assert topk.top_k(rows.where("id < 3"), queries.where("id = 0"), 20).count() == 2
    odd = spark.createDataFrame([([0.5, None],), ([float("nan")],), ([float("inf")],), (None,), ([],), ([-0.01],)], "v array<double>")
    assert [r[0] for r in odd.select(topk.usable(F.col("v"))).collect()] == [False, False, False, False, False, True]
    assert odd.where(topk.usable(F.col("v"))).select(topk.quantised(F.col("v"))).first()[0] == [-1]


def test_stages(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        full, none = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0, name
        if name != "tokens":
            assert full.columns == docs.columns == none.columns, name
        full.count()
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    mixed = corpus_pipeline.mixed(spark, docs, "").collect()
    assert not {2, 3, 6} & {r["doc_id"] for r in mixed}


def test_mixing_stage_takes_rows_by_their_own_words(spark, docs):
    """Rows without an id, and rows that share one, are taken as ``mix`` deals them words."""
    more = [(None, f"no id {'word ' * k}", "en", "web") for k in range(3, 9)] + [(20, "a " * k, "en", "book") for k in (5, 50, 500)]
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, SCHEMA))
    wanted = sorted((str(r["doc_id"]), r["size"]) for r in mixing.mix(rows).collect() for _ in range(-(-r["taken"] // max(1, r["size"]))))
    mixed = corpus_pipeline.mixed(spark, rows, "").collect()
    assert sorted((str(r["doc_id"]), len(r["text"].split())) for r in mixed) == wanted
    assert sum(r["doc_id"] is None for r in mixed) >= 6


def test_near_duplicates_stage_keeps_other_texts_of_an_id(spark):
    words = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, words("a")), (2, words("b")), (2, words("c")), (2, words("b")), (3, words("a")), (3, words("d")), (4, words("e")), (4, words("e") + " more"), (5, None), (5, ""), (5, None), (None, words("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((str(r["doc_id"]), str(r["text"])[:2]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    # 3's first text is a copy of 1's, and 4's texts are near copies: of each one stays.
    assert kept == [("1", "a0"), ("2", "b0"), ("2", "c0"), ("3", "d0"), ("4", "e0"), ("5", ""), ("5", "No"), ("None", "a0")]


def test_near_duplicates_with_repeated_ids(spark):
    """Ids that repeat with other texts, in buckets that stay open, against brute force."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):  # one family around the threshold: many buckets, many components
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 9))):
            own[at] = f"x{rng.integers(0, 9999)}"
        rows.append((int(rng.integers(0, 120)), " ".join(own)))
    rows += [(500, "a b c d e f"), (500, "g h i j k l"), (500, "m n o p q r"), (501, "a b c d e f"), (502, "g h i j k l"), (499, "m n o p q r"), (503, None), (503, "")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for p, (a, _) in enumerate(rows):
        for q in range(p):
            common = len(sets[p] & sets[q])
            if sets[p] and 100 * common >= 80 * (len(sets[p]) + len(sets[q]) - common):
                x, y = sorted((find(a), find(rows[q][0])))
                label[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for exact in (False, True):
        found = near_dup.near_duplicates(docs, exact=exact).collect()
        assert len(found) == len(rows)
        assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, find(i)) for i, _ in rows}
    assert len({find(i) for i, _ in rows}) > 5


@pytest.mark.parametrize("low, high, size", [(3, 10, 4000), (10, 160, 2500), (160, 600, 500)])
def test_recall_of_buckets_by_size(spark, low, high, size):
    """Pairs just at the threshold, by size of set: all are found."""
    import numpy as np

    rng = np.random.default_rng(low)
    rows = []
    for k in range(size):
        n = int(rng.integers(low, high))
        words = [f"v{k}.{j}" for j in range(n + 4)]
        gone = n // 5  # the first n shingles against the first n - n // 5: 0.8 or a little above
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n + 4 - gone]))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found.where("kept").count() == size


def test_url_rules_by_brute_force(spark):
    """Hosts with commas, brackets, dots and the control characters of keys: a rule fits its host and what is under it, and the longest wins."""
    rng = np.random.default_rng(21)
    labels = ["org", "example", "example,evil", "org,example", "com,x", "", ")", ")x", "x", "a\x01b", "a\x02b", "\x02c", "\x01", "com", "ORG"]
    host = lambda n: ".".join(rng.choice(labels, n))
    rules = {("org", "/"): "allow", ("example.org", "/a"): "block", ("org", "/aaaaaaaaaaaa"): "allow", ("example.org", "/aaaa"): "allow", ("example.org", "x"): "block", ("com", ""): "block"}
    for _ in range(40):
        rules.setdefault((host(int(rng.integers(1, 3))).lower(), str(rng.choice(["", "/", "/a", "/aa", "/b,)", "x"]))), str(rng.choice(["allow", "block"])))
    urls = [f"{rng.choice(['http', 'x'])}://{host(int(rng.integers(1, 5)))}{rng.choice(['', '/', '/a', '/aaaaaaaaaaaaa', '/b,)c', '?q', '#/a'])}" for _ in range(600)]
    urls += ["http://example,evil.org/es/1", "http://org,example/es/1", "http://com,x/fr/1", "http://example.org./a", "http://.example.org/a", "http://)x.example.org", "http://example.org/a"]
    want = []
    for u in urls:
        rest = u.split("://", 1)[1]
        h = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(h) :])[0]
        h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
        fits = [(len(rh + rp), len(rh), rh + rp, v) for (rh, rp), v in rules.items() if rh and (h == rh or h.endswith("." + rh)) and path.startswith(rp)]
        want.append((u, *(max(fits)[2:] if fits else (None, "allow"))))
    listed = spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, verdict string")
    found = url_rules.judge(spark.createDataFrame([(u,) for u in urls], "url string"), listed)
    assert sorted(map(str, ((r["url"], r["rule"], r["verdict"]) for r in found.collect()))) == sorted(map(str, want))
