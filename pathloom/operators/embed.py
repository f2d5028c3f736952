"""Token and trajectory embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import geo
from pathloom.operators.knn import knn_exact
from pathloom.operators.perturb import numbered
from pathloom.plans.storage import kept

#: Sentences that one task trains on.
SENTENCES_A_PART = 5_000
#: Numbers that an encoder holds of the points of a batch.
ENCODED = 8_000_000


def token_vectors(sentences: DataFrame, size: int = 100, window: int = 5, min_count: int = 1, rounds: int = 10, seed: int = 1, parts: int | None = None, most: float = 0.0) -> DataFrame:
    """word, vec: skip-gram vectors of the words of ``sentences`` (words: array of string).

    ``parts`` tasks train side by side on their share of sentences, and their vectors
    are averaged after each round; by default there is one for every
    SENTENCES_A_PART sentences. Sentences are dealt by a hash. One part gives the same
    vectors in each run; several are added up in any order and differ a little.
    With ``most`` above 0, longer vectors are brought to that length. Null or empty
    sentences teach nothing; without sentences there are no vectors.
    """
    rows = sentences.where(F.size("words") > 0).select("words")
    n = rows.count()
    if not n:
        return sentences.sparkSession.createDataFrame([], "word string, vec array<double>")
    parts = parts or -(-n // SENTENCES_A_PART)
    dealt = kept(rows.repartition(parts, F.xxhash64("words")).sortWithinPartitions("words"))
    model = Word2Vec(numPartitions=parts, vectorSize=size, windowSize=window, minCount=min_count, maxIter=rounds, seed=seed, inputCol="words", outputCol="_").fit(dealt)
    vectors = model.getVectors().select("word", vector_to_array("vector").alias("vec"))
    return vectors.withColumn("vec", shortened(F.col("vec"), most)) if most > 0 else vectors


def shortened(v: Column, most: float) -> Column:
    """The vector, brought to length ``most`` if it is longer."""

    def cut(u: Column, n: Column) -> Column:
        return F.when(n > most, F.transform(u, lambda x: x * F.lit(float(most)) / n)).otherwise(u)

    return once(v, lambda u: once(F.sqrt(geo.dot(u, u)), lambda n: cut(u, n)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def neighbour_sentences(neighbours: DataFrame) -> DataFrame:
    """Sentences of a token and its neighbours (token, rank, neighbour), as words, for skip-gram."""
    listed = neighbours.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("n"))
    return listed.select(F.concat(F.array(F.col("token").cast("string")), F.transform("n", lambda x: x["neighbour"].cast("string"))).alias("words"))


def keyword_sentences(points: DataFrame) -> DataFrame:
    """The keywords of each point, blanks written as hyphens."""
    return points.where(F.size("terms") > 0).select(F.transform("terms", lambda t: F.replace(t, F.lit(" "), F.lit("-"))).alias("words"))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""

    def scaled(u: Column, n: Column) -> Column:
        return F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u)

    return once(v.cast("array<double>"), lambda u: once(F.sqrt(geo.dot(u, u)), lambda n: scaled(u, n)))


def point_features(points: DataFrame, space: DataFrame, time: DataFrame, words: DataFrame, size: int = 100) -> DataFrame:
    """tid, pid, feature: space, time and keyword vectors of each point, end to end.

    ``points``: tid, pid, space_token, time_token, terms. Tables of vectors: word,
    vec, each word once. The keyword vector is the mean of the keywords' vectors at
    length 1, itself brought to length 1, and is worked out once for each distinct
    list of keywords. What is not in a table, or null, counts as zeros.
    """
    zero = F.array_repeat(F.lit(0.0), size)
    s = space.select(F.col("word").alias("_s"), F.col("vec").alias("s_vec"))
    t = time.select(F.col("word").alias("_t"), F.col("vec").alias("t_vec"))
    w = words.select(F.col("word").alias("_w"), unit(F.col("vec")).alias("vec"))
    each = points.select("terms").where(F.size("terms") > 0).distinct().select("terms", F.explode("terms").alias("term")).withColumn("term", F.replace("term", F.lit(" "), F.lit("-")))
    text = averaged(each.join(w, F.col("term") == F.col("_w")), "terms").select(F.col("terms").alias("_terms"), unit(F.col("vec")).alias("w_vec"))
    rows = points.join(s, F.col("space_token").cast("string") == F.col("_s"), "left").join(t, F.col("time_token").cast("string") == F.col("_t"), "left").join(text, F.col("terms") == F.col("_terms"), "left")
    return rows.select("tid", "pid", F.concat(F.coalesce("s_vec", zero), F.coalesce("t_vec", zero), F.coalesce("w_vec", zero)).alias("feature"))


def averaged(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, vec: the mean of each key's vectors, by partial sums of fixed size on the map side."""
    return vectors.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))).alias("vec"))


def mean_unit_vectors(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, vec: the mean of each key's vectors at length 1, itself brought to length 1."""
    return averaged(vectors.select(key, unit(F.col(vec)).alias("vec")), key).withColumn("vec", unit(F.col("vec")))


def pooled(features: DataFrame) -> DataFrame:
    """tid, vec: the mean of a trajectory's point features (what stands in where no trained weights are)."""
    return averaged(features, "tid", "feature")


@dataclass(frozen=True)
class EncoderWeights:
    """Weights of a point-attention LSTM encoder: input d, state h, attention width a."""

    w1: np.ndarray  # (2 h, a)
    w2: np.ndarray  # (d, a)
    v: np.ndarray  # (a,)
    wx: np.ndarray  # (d, 4 h): input, forget, cell, output
    wh: np.ndarray  # (h, 4 h)
    b: np.ndarray  # (4 h,)

    @staticmethod
    def seeded(d: int = 300, h: int = 256, a: int = 64, seed: int = 0) -> EncoderWeights:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return EncoderWeights(draw(2 * h, a), draw(d, a), draw(a), draw(d, 4 * h), draw(h, 4 * h), np.zeros(4 * h))


def attention(score: np.ndarray, t: int) -> np.ndarray:
    """Weights of step t: e^a over the (t + 1)-th root of the sum of e^a. Only at t = 0 do they add to 1."""
    e = np.exp(score)
    return e / e.sum(axis=-1, keepdims=True) ** (1 / (t + 1))


def encode(points: np.ndarray, w: EncoderWeights) -> np.ndarray:
    """The last states (b, h) of the encoder for b trajectories of the same length, (b, n, d) features.

    At step t all points are weighed by the state, and point t goes in by its weight.
    """
    h = np.zeros((len(points), len(w.wh)))
    c = np.zeros_like(h)
    keys = points @ w.w2
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t in range(points.shape[1]):
        weight = attention(np.tanh((np.concatenate([h, c], axis=1) @ w.w1)[:, None, :] + keys) @ w.v, t)
        x = weight[:, t, None] * points[:, t]
        i, f, g, o = np.split(x @ w.wx + h @ w.wh + w.b, 4, axis=1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
    return h


def encode_trajectories(features: DataFrame, weights: EncoderWeights) -> DataFrame:
    """tid, vec: encoder state of each trajectory (tid, pid, feature), trajectories of one length together.

    Points without a feature are left out, and trajectories without points have no
    row. At most ENCODED numbers of attention keys are held at a time.
    """
    nested = features.where("feature IS NOT NULL").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("pid", "feature"))).alias("p")).select("tid", F.col("p.feature").alias("f"))
    # Like lengths lie side by side.
    sorted_ = nested.withColumn("n", F.size("f")).repartitionByRange("n", "tid").sortWithinPartitions("n", "tid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, group in batch.groupby("n"):
                step = max(1, ENCODED // (int(n) * (weights.w2.shape[0] + weights.w2.shape[1])))
                for at in range(0, len(group), step):
                    part = group.iloc[at : at + step]
                    points = np.array([[*f] for f in part["f"]], float)
                    yield pd.DataFrame({"tid": part["tid"], "vec": [*encode(points, weights)]})

    return sorted_.mapInPandas(run, "tid long, vec array<double>")


def encode_tokens(points: DataFrame, space: DataFrame, time: DataFrame, words: DataFrame, weights: EncoderWeights, size: int = 100) -> DataFrame:
    """``encode_trajectories`` of ``point_features``, looked up where points are encoded: tokens are shuffled, features aren't.

    ``points`` and the tables as for ``point_features``. The tables go to all tasks, as
    vocabularies of trained vectors do in training; they grow with cells, time slots and
    keywords, not with points.
    """
    def table(vectors: DataFrame) -> tuple[dict[str, int], np.ndarray]:
        rows = vectors.select("word", "vec").collect()
        return {r["word"]: i for i, r in enumerate(rows)}, np.array([*(r["vec"] for r in rows), [0.0] * size])  # the last row: no vector

    (s_at, s_vec), (t_at, t_vec), (w_at, w_vec) = (table(x) for x in (space, time, words))
    to_unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=-1, keepdims=True)) > 0, n, 1)
    w_unit = to_unit(w_vec)
    point = F.struct("pid", F.col("space_token").cast("string").alias("s"), F.col("time_token").cast("string").alias("t"), F.array_join(F.transform("terms", lambda x: F.replace(x, F.lit(" "), F.lit("-"))), "\0").alias("w"))
    nested = points.groupBy("tid").agg(F.array_sort(F.collect_list(point)).alias("p"))
    # Like lengths lie side by side.
    sorted_ = nested.select("tid", F.col("p.s").alias("s"), F.col("p.t").alias("t"), F.col("p.w").alias("w"), F.size("p").alias("n")).repartitionByRange("n", "tid").sortWithinPartitions("n", "tid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zero = np.zeros(size)

        def text(listed: str | None) -> np.ndarray:
            at = [i for x in (listed or "").split("\0") if (i := w_at.get(x)) is not None]
            return to_unit(w_unit[at].mean(axis=0)) if at else zero

        for batch in batches:
            for n, group in batch.groupby("n"):
                step = max(1, ENCODED // (int(n) * (weights.w2.shape[0] + weights.w2.shape[1])))
                for at in range(0, len(group), step):
                    part = group.iloc[at : at + step]
                    lists = {x: text(x) for x in {y for z in part["w"] for y in z}}
                    looked = [np.array([[have.get(x, -1) for x in row] for row in part[c]]) for c, have in (("s", s_at), ("t", t_at))]
                    features = [s_vec[looked[0]], t_vec[looked[1]], np.array([[lists[x] for x in row] for row in part["w"]])]
                    yield pd.DataFrame({"tid": part["tid"], "vec": [*encode(np.concatenate(features, axis=2), weights)]})

    return sorted_.mapInPandas(run, "tid long, vec array<double>")


def save_weights(spark: SparkSession, weights: EncoderWeights, path: str, version: int) -> None:
    """Write the weights as rows of a Parquet table (name, shape, numbers), in the folder of their version, which must be new."""
    rows = [(n, list(v.shape), v.ravel().tolist()) for n, v in vars(weights).items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").write.parquet(f"{path}/version={version}")


def load_weights(spark: SparkSession, path: str, version: int | None = None) -> EncoderWeights:
    """The weights of a version, or of the highest one."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return EncoderWeights(**{r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in table.where(F.col("version") == version).collect()})


def save_vectors(vectors: DataFrame, path: str, version: int) -> None:
    """Write token vectors (word, vec) in the folder of their version, which must be new."""
    vectors.select("word", "vec").write.parquet(f"{path}/version={version}")


def load_vectors(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """word, vec of a version, or of the highest one."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version).select("word", "vec")


def neighbour_loss(truth: DataFrame, labels: DataFrame, logits: DataFrame, vectors: DataFrame, scale: float, by: str = "distance", mean_of: bool = False) -> DataFrame:
    """tid, pid, loss: cross entropies of a point's labels, weighed by how near their vectors are to the true one.

    ``truth``: tid, pid, vec; ``labels``: tid, pid, label (the true one and its
    neighbours); ``logits``: tid, pid, label, logit, of all labels of the vocabulary
    that the model gives; ``vectors``: word, vec. Weights are the softmax over a
    point's labels of minus the distance over ``scale``, or by ``cosine`` of the
    similarity over it (by ``-cosine`` of minus that). Losses are summed over labels,
    or averaged with ``mean_of``. Labels without a vector or a logit don't count, and
    points without labels that do have no row.
    """
    total = logits.groupBy("tid", "pid").agg(F.max("logit").alias("top"))
    total = logits.join(total, ["tid", "pid"]).groupBy("tid", "pid").agg((F.first("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top"))))).alias("all"))
    each = labels.join(vectors.select(F.col("word").alias("label"), F.col("vec").alias("near")), "label").join(truth.select("tid", "pid", "vec"), ["tid", "pid"]).join(logits, ["tid", "pid", "label"])
    closeness = {"distance": -geo.l2(F.col("near"), F.col("vec")), "cosine": 1 - geo.cosine_distance(F.col("near"), F.col("vec")), "-cosine": geo.cosine_distance(F.col("near"), F.col("vec")) - 1}[by]
    drawn = F.exp(F.coalesce(closeness, F.lit(0.0)) / F.lit(float(scale)) - F.max(F.coalesce(closeness, F.lit(0.0)) / F.lit(float(scale))).over(W.partitionBy("tid", "pid")))
    parts = each.join(total, ["tid", "pid"]).select("tid", "pid", drawn.alias("w"), (F.col("all") - F.col("logit")).alias("ce"))
    loss = F.sum(F.col("w") * F.col("ce")) / F.sum("w")
    return parts.groupBy("tid", "pid").agg((loss / F.count("*") if mean_of else loss).alias("loss"))


def sta_loss(truth: DataFrame, labels: dict[str, DataFrame], logits: dict[str, DataFrame], vectors: dict[str, DataFrame], alpha: float, beta: float, gamma: float, strict_reference: bool = False) -> DataFrame:
    """tid, loss: the losses of space, time and words (the keys of the dicts), summed over a trajectory's points.

    ``truth``: tid, pid and the true vectors space, time and words. Space and time go
    by distance (scales alpha, beta), words by cosine (gamma), each a weighted sum.
    ``strict_reference`` gives what published code computes instead: the space vector
    stands for all three, time goes by alpha, less similar words weigh more, and space
    and time are means over labels.
    """
    s = strict_reference
    how = {"space": (alpha, "distance", s), "time": (alpha if s else beta, "distance", s), "words": (gamma, "-cosine" if s else "cosine", False)}
    losses = [neighbour_loss(truth.select("tid", "pid", F.col("space" if s else part).alias("vec")), labels[part], logits[part], vectors[part], scale, by, mean_of) for part, (scale, by, mean_of) in how.items()]
    return losses[0].unionByName(losses[1]).unionByName(losses[2]).groupBy("tid").agg(F.sum("loss").alias("loss"))


def nearest_keywords(sets: DataFrame, words: DataFrame, k: int, size: int) -> DataFrame:
    """terms, rank, word, similarity: the k keywords by cosine nearest to the mean unit vector of each keyword set.

    ``sets``: terms, distinct; ``words``: word, vec. Words and sets are numbered in
    their order for the search in blocks; equally near words come in that order.
    """
    listed = kept(numbered(words, "word").withColumnRenamed("place", "id"))
    asked = kept(numbered(sets.select("terms"), "terms").withColumnRenamed("place", "qid"))
    each = asked.select("qid", F.explode("terms").alias("term")).select("qid", F.replace("term", F.lit(" "), F.lit("-")).alias("word"))
    means = mean_unit_vectors(each.join(words, "word"), "qid").withColumnRenamed("qid", "id")
    near = knn_exact(means, listed, k, "cosine")
    return near.join(listed.select("id", "word"), "id").join(asked, "qid").select("terms", "rank", "word", (1 - F.col("dist")).alias("similarity"))


def neighbour_share(vectors: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of true neighbours (token, neighbour) among the 2 k nearest vectors of each token.

    Words are token numbers; the vocabulary is compared with itself in blocks.
    """
    rows = vectors.select(F.col("word").cast("long").alias("id"), "vec")
    near = knn_exact(rows, rows, 2 * k, "l2", with_self=False).select(F.col("qid").alias("token"), F.col("id").alias("neighbour"), F.lit(1).alias("hit"))
    return truth.select("token", "neighbour").join(near, ["token", "neighbour"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
