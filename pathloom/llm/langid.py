"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's letters, in lower case and between boundary marks, give its character
n-grams; each n-gram is hashed to a row of an embedding table. A text is the
average of its n-grams' embeddings, and a linear softmax over it names the
language. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows, on whole texts and on short cuts from them. A
temperature fitted on rows kept aside calibrates the probabilities; a text whose
best calibrated probability is under the threshold is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import labelled_sample, per_batch

BUCKETS = 1 << 15
DIMENSIONS = 16
NGRAMS = (1, 2, 3, 4)
#: Bound of the training sample: rows for each label. Of these a share is kept aside for calibration.
PER_LABEL, ASIDE = 1500, 0.4
#: Calibration aims to reject this share of rows like the labelled ones, and never a probability above the second number.
REJECT_SHARE, MOST_REJECTED = 0.001, 0.5
#: Characters of the cuts that every other training step takes instead of a whole text.
CUT_CHARS = 600

@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


_LETTER: list[np.ndarray] = []
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    return _LETTER[0][codes]


def subwords(text: str | None) -> np.ndarray:
    """Bucket of each n-gram of the text's words, one after another; empty without letters.

    A word is a run of letters; an n-gram may begin or end with the mark of a
    word's boundary but not have one inside.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = is_letter(codes)
    if not letter.any():
        return np.empty(0, np.uint32)
    letter = np.concatenate([[False], letter, [False]])
    codes = np.where(letter, np.concatenate([[0], codes, [0]]), 1).astype(np.uint32)
    out = []
    for n in NGRAMS:
        size = len(codes) - n + 1
        if size < 1:
            break
        h = np.full(size, n, np.uint32)
        good = np.ones(size, bool)
        for k in range(n):
            h = (h ^ codes[k : k + size]) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1 or n == 1:
                good &= letter[k : k + size]
        if n == 2:
            good &= letter[:size] | letter[1:]
        out.append(h[good] & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def fit(texts: list[str], labels: list[str], seed: int = 0, epochs: int = 5, rate: float = 0.5) -> LanguageModel:
    """Train on the given rows; a share of them is kept aside for calibration.

    Steps take whole texts and short cuts by turns. The temperature and the
    threshold below which a text is rejected come from the rows kept aside.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    if not names:  # nothing to learn from: no language is named, and only texts without letters are rejected
        return LanguageModel([], np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros((DIMENSIONS, 0)), np.zeros(0))
    y = np.array([names.index(x) for x in labels])
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    order = rng.permutation(len(texts))
    cut = int(ASIDE * len(order))
    aside, used = order[:cut], order[cut:]
    steps, step = epochs * max(1, len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            lr = rate * (1 - step / steps)
            step += 1
            text = texts[i]
            n = int(rng.integers(10, CUT_CHARS))
            if step % 2 and len(text) > n:  # a cut, so that short texts are learned too
                at = int(rng.integers(0, len(text) - n))
                text = text[at : at + n]
            ids, times = np.unique(subwords(text), return_counts=True)
            if not len(ids):
                continue
            share = times / times.sum()
            h = share @ table[ids]
            z = h @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= lr * np.outer(h, p)
            bias -= 0.1 * lr * p
            table[ids] -= lr * 40 * share[:, None] * back
    model = LanguageModel(names, table.astype(np.float32), weights, bias)
    means = [(model.table[ids].mean(axis=0, dtype=np.float64), y[i]) for i in aside if len(ids := subwords(texts[i]))]
    if means:
        x, labels_aside = np.array([m for m, _ in means]), np.array([k for _, k in means])
        grid = np.geomspace(1, 20, 40)

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(model.probabilities(x)[np.arange(len(x)), labels_aside] + 1e-12).mean()

        model.temperature = float(min(grid, key=loss))
        best = model.probabilities(x).max(axis=1)
        model.threshold = float(min(MOST_REJECTED, np.quantile(best, REJECT_SHARE)))
    return model


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> LanguageModel:
    """Fit on about ``per_label`` rows of each label; rows without text or label take no part."""
    usable = rows.select("doc_id", F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    sample = sorted(labelled_sample(usable, "label", per_label).select("label", "text").collect())
    return fit([r["text"] for r in sample], [r["label"] for r in sample])


class Predictor:
    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        #: The softmax is linear in the average: each n-gram's share of the logits is known beforehand.
        self.votes = np.ascontiguousarray(model.table.astype(np.float64) @ model.weights)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and whether it is rejected, of each text."""
        model = self.model
        names, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            ids = subwords(text)
            if not len(ids):
                rejected[k] = True
            elif model.labels:
                z = (self.votes[ids].mean(axis=0) + model.bias) / model.temperature
                best = int(z.argmax())
                names[k], score[k] = model.labels[best], min(1.0, 1 / float(np.exp(z - z[best]).sum()))
                rejected[k] = score[k] < model.threshold
        return names, score, rejected


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score and rejected of every row's whole text.

    A text that is null or has no letter is ``und`` with score 0, and rejected; of
    labels that are equally likely the first by name is given. Rows are judged one
    by one, so ids may be null or repeat, and an empty table gives an empty table.
    Only the two columns are read. A model without labels names none.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType(
        [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )

    def make():
        predictor = Predictor(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, score, rejected = predictor(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], schema.names)

        return work

    return per_batch(rows, make, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected.

    Rows without a letter go; repeated rows go or stay together. Columns may have
    any names, and an empty table gives an empty table.
    """

    def make():
        predictor = Predictor(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(~predictor(batch.column(text_col).to_pylist())[2]))

        return work

    return per_batch(docs, make, docs.schema)
