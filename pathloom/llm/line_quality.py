"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. A line's features describe it and its two
neighbours; a 2 x 2 transition matrix ties successive labels. Training takes the
label of a document for all its lines and maximises the conditional likelihood
on a bounded sample of labelled documents. The quality of a document is the mean
of its lines' forward-backward marginals for "good", weighted by line length.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import labelled_sample, per_batch

#: Bound of the training sample: documents for each label.
PER_LABEL = 1500
FEATURES = ("words", "chars", "symbols", "marks", "upper", "digits", "distinct", "word_length", "ends", "repeated", "top_word", "short", "doc_repeat", "doc_lines")
#: Documents times lines that are worked on at once.
CELLS = 1_000_000

UPPER, DIGITS, SYMBOLS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>{}[]\\^~=_@", b"!?;:"
ENDINGS = (b".", b"!", b"?")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with words (one empty line if there is none), and the lines' lengths."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()] or [b""]
    rows = []
    seen_lines: set[bytes] = set()
    seen: set[bytes] = set()
    for line in lines:
        words = line.split()
        own = set(words)
        size = len(line)
        rows.append(
            (
                len(words),
                size,
                size - len(line.translate(None, SYMBOLS)),
                size - len(line.translate(None, MARKS)),
                size - len(line.translate(None, UPPER)),
                size - len(line.translate(None, DIGITS)),
                len(own),
                line.endswith(ENDINGS),
                line in seen_lines,
                1 if len(own) == len(words) else max(Counter(words).values()),
            )
        )
        seen_lines.add(line)
        seen |= own
    raw = np.array(rows, np.float64)
    n, size, symbols, marks, upper, digits, own_n, ends, again, most = raw.T
    words = np.maximum(n, 1)
    chars = np.maximum(size, 1)
    total = n.sum()
    columns = (
        np.log1p(n) / 5,
        np.log1p(size) / 6,
        symbols / words,
        marks / words,
        upper / chars,
        digits / chars,
        own_n / words,
        size / words / 10,
        ends,
        again,
        np.where(n > 4, most / words, 0),
        n < 4,
        np.full(len(raw), 1 - len(seen) / total if total else 1),
        np.full(len(raw), np.log1p(len(raw)) / 5),
    )
    return np.minimum(np.stack(columns, axis=1), 3).astype(np.float32), chars


def with_neighbours(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its document, and a constant.

    ``new`` marks the first lines of documents.
    """
    before = np.roll(x, 1, axis=0)
    before[new] = 0
    after = np.roll(x, -1, axis=0)
    after[np.append(new[1:], True)] = 0
    return np.hstack([x, before, after, new[:, None], np.append(new[1:], True)[:, None], np.ones((len(x), 1))])


def forward_backward(good: np.ndarray, size: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of padded chains: P(good) of each line, the pair marginals summed, log partition.

    ``good`` (chains x lines): score of "good"; "bad" scores 0. ``step``: 2 x 2 transition scores.
    """
    chains, lines = good.shape
    alpha = np.zeros((lines, chains, 2))
    beta = np.zeros((lines, chains, 2))
    alpha[0, :, 1] = good[:, 0]
    for t in range(1, lines):
        into = np.logaddexp(alpha[t - 1, :, :1] + step[0], alpha[t - 1, :, 1:] + step[1])
        into[:, 1] += good[:, t]
        alpha[t] = np.where((t < size)[:, None], into, alpha[t - 1])
    whole = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    pairs = np.zeros((2, 2))
    for t in range(lines - 2, -1, -1):
        ahead = beta[t + 1].copy()
        ahead[:, 1] += good[:, t + 1]
        inside = (t + 1 < size)[:, None]
        beta[t] = np.where(inside, np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1]), 0)
        joint = np.exp(alpha[t, :, :, None] + step[None] + ahead[:, None, :] - whole[:, None, None])
        pairs += (joint * inside[:, :, None]).sum(axis=0)
    return np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole).T, pairs, whole


@dataclass
class LineModel:
    weights: np.ndarray
    step: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float = 0.5

    def marginals(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """P(good) of each line of each document, in parts of at most CELLS cells (or one document)."""
        out: list[np.ndarray] = [np.empty(0)] * len(found)
        order = sorted(range(len(found)), key=lambda k: len(found[k][0]))
        while order:
            most = len(found[order[-1]][0])
            part = [order.pop() for _ in range(max(1, min(len(order), CELLS // most)))]
            sizes = np.array([len(found[k][0]) for k in part])
            x = np.vstack([found[k][0] for k in part])
            new = np.zeros(len(x), bool)
            new[np.cumsum(sizes) - sizes] = True
            good = np.zeros((len(part), most))
            inside = np.arange(most) < sizes[:, None]
            good[inside] = with_neighbours((x - self.mean) / self.scale, new) @ self.weights
            p = forward_backward(good, sizes, self.step)[0]
            for k, row, n in zip(part, p, sizes, strict=True):
                out[k] = row[:n]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [line_features(t) for t in texts]
        return np.array([min(1.0, float(p @ length / length.sum())) for p, (_, length) in zip(self.marginals(found), found, strict=True)])


def fit(texts: list[str | None], labels: list[int], rounds: int = 200, rate: float = 0.05, decay: float = 1e-3) -> LineModel:
    """Gradient ascent (Adam) on the conditional log-likelihood; each label weighs as its share of documents."""
    if not texts:  # nothing to learn from: every document scores one half
        n = len(FEATURES)
        return LineModel(np.zeros(3 * n + 3), np.zeros((2, 2)), np.zeros(n), np.ones(n))
    found = [line_features(t) for t in texts]
    # Very long documents would rule the gradient: a line weighs 1 / root of its document's lines.
    sizes = np.array([len(f) for f, _ in found])
    order = np.argsort(sizes, kind="stable")
    x = np.vstack([found[k][0] for k in order])
    y = np.array(labels, float)[order]
    sizes = sizes[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    new = np.zeros(len(x), bool)
    starts = np.cumsum(sizes) - sizes
    new[starts] = True
    full = with_neighbours((x - mean) / scale, new)
    weights, step = np.zeros(full.shape[1]), np.zeros((2, 2))
    moved = [np.zeros(full.shape[1] + 4) for _ in range(2)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    share = 1 / np.sqrt(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):  # parts with chains of like length
        at, end = cuts[-1], cuts[-1] + 1
        while end < len(sizes) and (end + 1 - at) * sizes[end] <= CELLS and sizes[end] <= 2 * sizes[at] + 4:
            end += 1
        cuts.append(end)
    for r in range(1, rounds + 1):
        score = full @ weights
        p = np.empty(len(x))
        grad_step = np.zeros((2, 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            size = sizes[a:b]
            lines = slice(starts[a], starts[b - 1] + sizes[b - 1])
            inside = np.arange(size.max()) < size[:, None]
            good = np.zeros(inside.shape)
            good[inside] = score[lines]
            marginal, pairs, _ = forward_backward(good, size, step)
            p[lines] = marginal[inside]
            weight = share[a:b].mean()
            for label in (0, 1):
                grad_step[label, label] += weight * ((size - 1) * (y[a:b] == label)).sum()
            grad_step -= weight * pairs
        grad = np.append(full.T @ ((y[doc] - p) * share[doc]), grad_step) / len(sizes)
        grad -= decay * np.append(weights, step)
        for m, power, keep in ((moved[0], 1, 0.9), (moved[1], 2, 0.999)):
            m *= keep
            m += (1 - keep) * grad**power
        move = rate * (moved[0] / (1 - 0.9**r)) / (np.sqrt(moved[1] / (1 - 0.999**r)) + 1e-8)
        weights += move[:-4]
        step += move[-4:].reshape(2, 2)
    return LineModel(weights, step, mean, scale)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_label: int = PER_LABEL) -> LineModel:
    """Fit on about ``per_label`` labelled documents of each label.

    The sampled ids are at most a few thousand by that bound, so their join with
    the documents is a broadcast.
    """
    chosen = labelled_sample(labels.select("doc_id", F.col(label_col).alias("label")), "label", per_label)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted(sample.collect())
    return fit([r["text"] for r in rows], [int(r["label"]) for r in rows])


def score(df: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score and predicted of every row's whole text; null and empty texts count as one empty line.

    Rows are scored one by one, so ids may be null or repeat, and equal texts score
    alike; an empty table gives an empty table. Only the two columns are read.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = model.scores(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found), pa.array((found >= model.threshold).astype(np.int32))], schema.names)

        return work

    return per_batch(rows, make, schema)


def keep_good(docs: DataFrame, model: LineModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good.

    Repeated rows go or stay together. Columns may have any names, and an empty
    table gives an empty table.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(model.scores(batch.column(text_col).to_pylist()) >= model.threshold))

        return work

    return per_batch(docs, make, docs.schema)
