"""Parts of the operators against enumeration, plain arithmetic and the libraries."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from pathloom.llm import langid, line_quality, merge_tokens, token_files, topk
from pathloom.llm.queries import piece_model


def test_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 2, 5, 4])
    good, step = rng.normal(size=(4, 5)), rng.normal(size=(2, 2))
    p, pairs, whole = line_quality.forward_backward(good, sizes, step)
    total = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        weights, ones, moves = [], np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            score = sum(good[k, t] for t in range(n) if labels[t]) + sum(step[a, b] for a, b in zip(labels, labels[1:], strict=False))
            weights.append(np.exp(score))
            ones += weights[-1] * np.array(labels)
            for a, b in zip(labels, labels[1:], strict=False):
                moves[a, b] += weights[-1]
        z = sum(weights)
        assert p[k, :n] == pytest.approx(ones / z)
        assert whole[k] == pytest.approx(np.log(z))
        total += moves / z
    assert pairs == pytest.approx(total)


def test_gradient_of_the_chain():
    """The marginals are the gradient of the log partition, by differences."""
    rng = np.random.default_rng(6)
    sizes, good, step = np.array([4, 3]), rng.normal(size=(2, 4)), rng.normal(size=(2, 2))
    whole = lambda g, s: line_quality.forward_backward(g, sizes, s)[2].sum()
    p, pairs, _ = line_quality.forward_backward(good, sizes, step)
    e = 1e-6
    for k, t in ((0, 0), (0, 3), (1, 2)):
        moved = good.copy()
        moved[k, t] += e
        assert (whole(moved, step) - whole(good, step)) / e == pytest.approx(p[k, t], abs=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        moved = step.copy()
        moved[a, b] += e
        assert (whole(good, moved) - whole(good, step)) / e == pytest.approx(pairs[a, b], abs=1e-4)


def test_document_score_weighs_lines_by_length():
    model = line_quality.fit(["A good line of words.\nAnother good line here."] * 10 + ["### $$$ ###\n### $$$"] * 10, [1] * 10 + [0] * 10, rounds=30)
    text = "A good line of words.\n### $$$ ###\n\nAnother good one, and a long one at that."
    features, lengths = line_quality.line_features(text)
    p = model.marginals([(features, lengths)])[0]
    assert lengths.tolist() == [21, 11, 41]
    assert model.scores([text])[0] == pytest.approx((p * lengths).sum() / lengths.sum())


def test_subwords_are_those_of_words():
    for text in ("a", "ab c", "Über, den Fluß!", "x1y2 z", "日本語 text", "  a  "):
        # 1-grams have no mark; longer ones may begin or end with one: n letters give n + 3 - size of each size from 2 on.
        want = sum(max(0, n + 2 - size + 1) if size > 1 else n for n in map(len, _words(text)) for size in langid.NGRAMS)
        assert len(langid.subwords(text)) == want
    assert len(langid.subwords("1 2 !")) == len(langid.subwords(None)) == 0


def _words(text):
    out = [""]
    for c in text.lower():
        out = [*out[:-1], out[-1] + c] if c.isalpha() else [*out, ""]
    return [w for w in out if w]


SYLLABLES = {"aa": "ba be bi bo da de di do", "bb": "kur gur mur nur tul wul zul ful", "cc": "shi chi tsu kyo ryu myo hya nya", "dd": "osti anti enti asti ilmo olmo elno arno"}


def made_text(rng, label, n):
    parts = SYLLABLES[label].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_calibration_and_rejection():
    rng = random.Random(3)
    labels = [x for x in SYLLABLES for _ in range(150)]
    model = langid.fit([made_text(rng, x, rng.randint(3, 60)) for x in labels], labels)
    predictor = langid.Predictor(model)
    held = [(x, made_text(rng, x, rng.randint(3, 60))) for x in SYLLABLES for _ in range(100)]
    names, score, rejected = predictor([t for _, t in held])
    right = np.array([n == x for n, (x, _) in zip(names, held, strict=True)])
    assert right.mean() > 0.98
    assert rejected.mean() < 0.02
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(right[bins == b].mean() - score[bins == b].mean()) * (bins == b).mean() for b in set(bins))
    assert error < 0.05  # expected calibration error
    # The same softmax, worked out from the embeddings.
    ids = langid.subwords(held[0][1])
    p = model.probabilities(model.table[ids].astype(float).mean(axis=0)[None])[0]
    assert score[0] == pytest.approx(p.max()) and names[0] == model.labels[int(p.argmax())]
    # Letters that no learned language has are rejected.
    strange = ["".join(rng.choice("жщюяфэъыбдгпл ") for _ in range(200)) for _ in range(20)]
    assert predictor(strange)[2].mean() > 0.9


def test_blocks_of_ids():
    rng = np.random.default_rng(1)
    cases = [
        np.array([7], np.uint32),
        np.full(4096, 123456, np.uint32),  # width 0
        rng.integers(0, 1 << 32, 4096, dtype=np.uint32),  # width 32
        np.array([0, (1 << 32) - 1], np.uint32),
        np.where(np.arange(4096) % 20 == 0, (1 << 32) - 1, rng.integers(0, 50, 4096)).astype(np.uint32),  # a few exceptions
        rng.integers(0, 49000, 77, dtype=np.uint32),
    ]
    for values in cases:
        for percentile in (0, 50, 90, 100):
            data = token_files.pack_block(values, percentile)
            assert token_files.unpack_block(data).tolist() == values.tolist()
    width = lambda data: data[4]
    assert width(token_files.pack_block(cases[1])) == 0 and width(token_files.pack_block(cases[2])) == 32
    assert len(token_files.pack_block(cases[4])) < 4096 * 2  # outliers don't widen the rest


def test_ids_by_range(tmp_path):
    rng = np.random.default_rng(2)
    writer = token_files.TokenFileWriter(f"file://{tmp_path}/x.plt")
    docs = [rng.integers(0, 49000, int(n), dtype=np.uint32) for n in (0, 1, 4095, 1, 9000, 3, 20000)]
    for k, ids in enumerate(docs):
        writer.add(k if k else None, ids)
    writer.close()
    whole = np.concatenate(docs)
    f = token_files.TokenFile(f"file://{tmp_path}/x.plt")
    for start, n in ((0, 0), (0, 1), (4090, 20), (8192, 4096), (len(whole) - 5, 5), (0, len(whole))):
        assert f.ids(start, n).tolist() == whole[start : start + n].tolist()
    assert [(i, x.tolist()) for i, x in f.documents()] == [(k if k else None, x.tolist()) for k, x in enumerate(docs)]


def test_word_encoder_on_every_letter():
    from tests.llm.test_cases import definition

    library = tokenizers.Tokenizer.from_str(definition())
    encoder = token_files.WordEncoder(definition())
    texts = [f"a{chr(k)}b {chr(k)}! {chr(k)}{chr(k)}'s" for k in range(0xA0, 0x10000) if not 0xD800 <= k < 0xE000]
    rng = random.Random(5)
    letters = [chr(k) for k in (*range(0x20, 0x250), *range(0x370, 0x400), 0x1E9E, 0x2019, 0x4E00, 0x1F600)]
    texts += ["".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(" \n'.,") for _ in range(rng.randint(1, 14))) for _ in range(50_000)]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    for text, ids, want in zip(texts, encoder.encode(pa.array(texts)), wanted, strict=True):
        assert ids.tolist() == want.ids, text


def test_merge_encoder_on_odd_and_unspaced_texts():
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    encoder = merge_tokens.MergeEncoder(piece_model())
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABC  éüñßøœ.,;'\"-_#$%123▁\n\t的一是不了人我在有他这ДжЯ​́😀"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        assert encoder.encode(text) == library.encode(text), repr(text)
    long = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200_000)), "".join(rng.choice("abcdefghijé") for _ in range(200_000)), "a" * 200_000, "的一是不了人我在" * 25_000]
    for text in long:
        assert encoder.encode(text) == library.encode(text)
    assert all(len(k) <= merge_tokens.CACHE_CHARS for kept in (encoder.units, encoder.segments) for k in kept)


def test_compatibility_is_that_of_merging():
    encoder = merge_tokens.MergeEncoder(piece_model())
    rng = random.Random(2)
    ids = [*encoder.pieces.values()]
    whole = [i for i in ids if encoder.merged(encoder.text[i]) == [encoder.text[i]]]
    for _ in range(20_000):
        a, b = rng.choice(whole), rng.choice(whole)
        assert encoder.compatible(a << 20 | b) == (encoder.merged(encoder.text[a] + encoder.text[b]) == [encoder.text[a], encoder.text[b]])


def test_postings_by_brute_force():
    rng = np.random.default_rng(1)
    for shape, high in itertools.product(((1, 1), (5, 3), (65, 2), (700, 6), (900, 40)), (1, 9, 1000)):
        for sign in (0, 1, -1):
            vectors = rng.integers(-high, high + 1, shape)
            vectors = vectors if not sign else sign * np.abs(vectors)
            ids = rng.permutation(10 * len(vectors))[: len(vectors)]
            postings = topk.Postings(vectors, ids)
            for i in range(min(12, len(ids))):
                scores = vectors @ vectors[i]
                others = np.flatnonzero(ids != ids[i])
                best = others[np.lexsort((ids[others], -scores[others]))[:20]]
                want = [(int(ids[j]), int(scores[j])) for j in best]
                for threshold in [None, *([want[-1][1], want[9][1]] if len(want) == 20 else [])]:
                    found, score, _ = postings.search(vectors[i], int(ids[i]), 20, threshold)
                    got = sorted(zip(found.tolist(), score.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:20]
                    assert [x for x in got if threshold is None or x[1] >= threshold] == [x for x in want if threshold is None or x[1] >= threshold]


@pytest.mark.parametrize("scale", [8, 5_000, 300_000_000])
def test_queries_walk_postings_together(scale):
    """A block of queries finds what brute force finds, over several stretches, with and without thresholds, in all kinds of numbers."""
    rng = np.random.default_rng(scale)
    vectors, ids = rng.integers(-scale, scale + 1, (5000, 12)), rng.permutation(5000)
    postings = topk.Postings(vectors, ids)
    exact = vectors[:40] @ vectors.T
    for thresholds in ([None] * 40, [int(np.sort(np.delete(e, i))[-20]) if i % 2 else None for i, e in enumerate(exact)]):
        for i, (found, score, t) in enumerate(postings.search_all(vectors[:40], ids[:40], 20, thresholds)):
            want = sorted(((-int(s), int(j)) for s, j in zip(exact[i], ids, strict=True) if j != ids[i]))[:20]
            assert sorted(zip((-score).tolist(), found.tolist(), strict=True)) == want and t == -want[-1][0]
