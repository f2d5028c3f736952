"""Source divergence, token alignment and streaming dedup against brute force, with nulls, ties, repeats and odd names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from pathloom.llm import alignment, divergence, exact_dedup
from pathloom.llm.queries import QUERIES, piece_model
from tests.sql import SF

DOCS = "doc_id long, text string, lang string, source string"


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def audited(rows, min_docs, k):
    """The contract, pair by pair and term by term."""
    docs = [(lang or "", source or "", [lowered(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    have, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        have[lang].update(set(words))
        count[lang, source].update(words)
        count[lang, None].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in have[lang].items() if n >= min_docs)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        p = {}
        for s in [*sources, None]:
            n = sum(count[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            tops = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t])[:k]
            for part, found in (("pair", pairs), ("term", tops)):
                out += [(lang, s, part, item, -v, rank) for rank, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def found_by_audit(spark, rows, min_docs, k, schema=DOCS):
    df = divergence.audit(spark.createDataFrame(rows, schema).repartition(3), min_docs=min_docs, k=k)
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def odd_documents():
    rng = np.random.default_rng(5)
    words = ["the", "The", "café", "Ünder", "日本", "z", *(f"{'x' * n}{c}" for n in (1, 40, 300) for c in "abcdef"), *("w" + chr(0xE000 + k) for k in range(20)), "\U00010348q"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(0, 60)))), ["de", "en", None][k % 3], f"s{k % 5}" if k % 7 else None) for k in range(90)]
    return rows + [(None, None, "en", "empty"), (3, "", "fr", "one"), (3, "123 ...", "fr", "two"), (4, "alone", "xx", "")]


@pytest.mark.parametrize("k", [1, 4, 200])
def test_audit_by_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 2)  # sources of a term in several rows
    rows = odd_documents()
    assert found_by_audit(spark, rows, 3, k) == audited(rows, 3, k)


def test_audit_of_repeats_and_nothing(spark):
    rows = [(1, "same text here", "en", s) for s in "ab" for _ in range(4)]
    assert found_by_audit(spark, rows, 3, 5) == audited(rows, 3, 5)
    assert found_by_audit(spark, [], 3, 5) == []
    named = spark.createDataFrame([(1, "a b", "en", "s", 1, 2, "x")], DOCS + ", gid long, value long, term string")
    assert divergence.audit(named).collect() == []


def test_radix_select_of_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(v), f"{'common' * 5}{i:05d}") for g in range(3) for i, v in enumerate(rng.choice([0, 1, 7, 7 << 40, 7 << 40, (1 << 59) + 3], 400))]
    rows += [(9, 5, "a"), (9, 5, "b"), (10, 0, "")]
    for k in (1, 60, 390):
        found = divergence.radix_select(spark.createDataFrame(rows, "gid long, value long, item string"), k).collect()
        expected = [r for g in (0, 1, 2, 9, 10) for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k]]
        assert sorted(map(tuple, found)) == sorted(expected)


# Alignment


def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=piece_model())


def ranges(spelled):
    ends = np.cumsum([len(x) for x in spelled]).tolist()
    return list(zip([0, *ends], ends, strict=False))


def aligned_alone(text, a, b):
    """Ids, groups and links of one text by comparing byte ranges."""
    letters = alignment.byte_of()
    if not text:
        return [], [], [], []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    sa = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    sb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(sa) != (" " + text).encode() or b"".join(sb) != (" " + text).encode():
        return [], [], [], []
    ra, rb = ranges(sa), ranges(sb)
    groups, start = [], 0
    for end in sorted({y for _, y in ra} & {y for _, y in rb}):
        groups.append("|".join(",".join(str(i) for i, (_, y) in zip(ids, r, strict=True) if start < y <= end) for ids, r in ((ia, ra), (ib, rb))))
        start = end
    links = [(x, y) for x, (p, q) in zip(ia, ra, strict=True) for y, (r, s) in zip(ib, rb, strict=True) if p < s and r < q]
    return ia, ib, groups, links


def alignments(rows):
    a, b = libraries()
    each = [(doc_id, *aligned_alone(text, a, b)) for doc_id, text in rows]
    count = Counter(p for *_, links in each for p in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, ia, ib, groups, links in each:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""
        out.append((doc_id, len(ia), len(ib), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(map(str, out)), count


ODD = [
    None, "", " ", "a", "a b", "a  b", "  a", "a ", "\n", "a\n b", "a \nb", "tab\there", "<|endoftext|> <s> <0x41>", "it's we'll  I'M", "日本語 のテキスト", "▁x ▁", "é ́x", "  　 ​",
    "1234567890 3.14", "\U0001f600 \U0001f9d1‍\U0001f4bb", "x" * 5000, "ab" * 3000 + " " + "c d " * 2000, "mixed 日 x 本", "\x00 \x7f", "Ünïcode çafé ÀÉ ɏ ɐ a", "a b" * 50,
]


@pytest.mark.parametrize("hot", [1 << 16, 5, 0])
def test_alignment_by_byte_ranges(spark, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", hot)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").collect()][:60]
    rng = np.random.default_rng(8)
    letters = list("ab e's  \n\t.,1é日ɐ́▁<>|X")
    texts += [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000 + k, "".join(rng.choice(letters, 60))) for k in range(150)] + [(None, "no id"), (1001, "a b")]
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, row int").repartition(4)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found, counts = alignment.align(df, f.read(), piece_model())
    expected, count = alignments(texts)
    assert sorted(str(tuple(r[c] for c in "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split())) for r in found.collect()) == expected
    assert {(r["a"], r["b"]): r["count"] for r in counts.collect()} == count
    first = {(r["a"], r["rank"]): r["count"] for r in alignment.ranked_pairs(counts, 1).collect()}
    assert first == {(a, 1): max(n for (x, _), n in count.items() if x == a) for a in {a for a, _ in count}}
    assert {(r["a"], r["b"]) for r in alignment.likely_translations(counts, 2).collect()} == {p for p, n in count.items() if n >= 2 and n == first[p[0], 1]}


def test_alignment_of_nothing(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found, counts = alignment.align(spark.createDataFrame([], DOCS), f.read(), piece_model())
    assert found.collect() == [] and counts.collect() == []


# Exact duplicates


def deduplicated(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[lowered(text or "")].append((doc_id is not None, doc_id or 0, k))
    out = []
    for text, members in groups.items():
        keep = max(members)
        out += [(m[1] if m[0] else None, keep[1] if keep[0] else None, len(members), m == keep, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(map(str, out))


def found_by_stream(df):
    return sorted(str(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256"))) for r in df.collect())


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_stream_keeps_its_state(spark, tmp_path, digest_bytes, monkeypatch):
    """Two runs of one state, the second over new files; with digests of one byte nearly every hit is another text."""
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    rng = np.random.default_rng(4)
    texts = [None, "", "Ä", "ä", "A\nb", "a\nB", "x" * 100_000, *(f"Text {k // 2}" for k in range(400))]
    rows = [(int(k) if k % 11 else None, texts[int(rng.integers(0, len(texts)))]) for k in rng.permutation(900)] + [(5000, "twice"), (5000, "twice"), (5000, "TWICE "), *((6000 + k, "hot") for k in range(300))]
    path, state = str(tmp_path / "docs"), f"file://{tmp_path}/state"
    schema = "doc_id long, text string, digest string, stay int"
    for at in (0, 700):
        part = rows[at : at + 700] if not at else rows[700:]
        spark.createDataFrame([(d, t, "z", 1) for d, t in part], schema).coalesce(2).write.mode("append").parquet(path)
        found = exact_dedup.exact_dedup(spark, path, location=state, digest_bytes=digest_bytes, bytes_per_batch=1)
        seen = rows[: at + len(part)]
        # Of equal ids and texts, which row is marked doesn't show.
        assert found_by_stream(found) == deduplicated(seen)
    assert spark.read.format("statestore").load(state).count() <= 256 or digest_bytes == 32


def test_stream_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "none")).collect() == []


def test_native_plan(spark):
    plan = QUERIES["op13_exact_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
