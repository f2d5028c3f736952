"""Known values of functions and measures, and agreement of their forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo, keywords, measures, tokens

A = [(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (3.0, 3.0)]
B = [(0.0, 1.0), (2.0, 1.0), (3.0, 2.0)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def points(pts):
    if not pts:
        return F.array().cast("array<struct<x:double,y:double>>")
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pts))


def test_haversine(spark):
    v = value(spark, geo.haversine(F.lit(116.74599), F.lit(40.16957), F.lit(116.37497), F.lit(39.85789)))
    assert v == pytest.approx(46951.3574, abs=1e-3)


def test_boxes(spark):
    lit = lambda *v: dict(zip(geo.BOX, map(F.lit, v), strict=True))
    a, b, empty = lit(0.0, 0.0, 2.0, 2.0), lit(5.0, 6.0, 7.0, 8.0), {n: F.lit(None).cast("double") for n in geo.BOX}
    assert value(spark, geo.box_distance(a, b)) == 5.0
    assert value(spark, geo.box_distance(a, lit(1.0, 1.0, 9.0, 9.0))) == 0.0
    assert value(spark, geo.diagonal(a)) == pytest.approx(math.sqrt(8))
    assert value(spark, geo.diagonal(empty)) == 0.0
    assert value(spark, geo.area(empty)) == 0.0
    assert value(spark, F.array(*geo.union(a, empty).values())) == [0.0, 0.0, 2.0, 2.0]
    assert value(spark, F.array(*geo.include(a, F.lit(-1.0), F.lit(3.0)).values())) == [-1.0, 0.0, 2.0, 3.0]
    assert value(spark, geo.cell_distance(F.lit(0), F.lit(0), F.lit(4), F.lit(5))) == 5.0
    assert value(spark, geo.cell(F.lit(-0.5), 1.0)) == -1


def test_sigmoid(spark):
    assert value(spark, geo.sigmoid(F.lit(0.0), 0.1)) == 1.0
    assert value(spark, geo.sigmoid(F.lit(1e12), 0.1)) == pytest.approx(0.0)
    assert value(spark, geo.identity(F.lit(3.5), 0.1)) == 3.5


def test_jaccard(spark):
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    assert value(spark, keywords.jaccard(words(), words())) == 1.0
    assert value(spark, keywords.jaccard(words("a"), words())) == 0.0
    assert value(spark, keywords.jaccard(words("a", "a", "b"), words("b"))) == 0.5
    assert value(spark, keywords.split_terms(F.lit(""))) == []
    assert value(spark, keywords.normalise(F.lit("a b c"))) == "a-b-c"


def test_measures(spark):
    a, b = points(A), points(B)
    assert value(spark, measures.dtw(a, b)) == pytest.approx(3.414213562)
    assert value(spark, measures.edr(a, b, 1.0)) == 1.0
    assert value(spark, measures.erp(a, b)) == pytest.approx(2.414213562)
    assert value(spark, measures.lcss(a, b, 1.0, 1)) == 1.0
    assert value(spark, measures.lcss(a, b, 1.0, 0)) == 5.0
    assert value(spark, measures.lcss(a, b, 1.0, 1, normalized=True)) == pytest.approx(1 - 3 / 4)


def test_measures_of_empty(spark):
    a, none = points(A), points([])
    assert value(spark, measures.dtw(a, none)) is None
    assert value(spark, measures.edr(a, none, 1.0)) == 4.0
    assert value(spark, measures.erp(none, points([(3.0, 4.0)]))) == 5.0
    assert value(spark, measures.lcss(a, none, 1.0, 1)) == 4.0


def test_tokens(spark):
    assert value(spark, tokens.space_token(F.lit(6.0), F.lit(4.5), 0, 0, 16, 9, 4, 3)) == 5
    assert value(spark, F.array(*tokens.token_cell(F.lit(5), 4))) == [1, 1]
    assert value(spark, tokens.time_neighbours(F.lit(5), 4, 10)) == [4, 6, 3, 7]
    assert value(spark, tokens.time_neighbours(F.lit(0), 3, 3)) == [1, 2]
    assert value(spark, tokens.with_self(F.lit(5), tokens.time_neighbours(F.lit(5), 2, 10))) == [5, 4, 6]
    assert value(spark, tokens.time_token(F.lit(-5), 0, 100, 10)) == 0
    assert tokens.vocabulary_sizes(0, 100, 10, (0, 0, 16, 9), 4, 3) == (11, 3 * 4 + 4)


def test_space_neighbours(spark):
    near = tokens.space_neighbours(spark.createDataFrame([(24,)], "token long"), 20, 7, 7).orderBy("rank")
    assert [r["neighbour"] for r in near.collect()] == [25, 31, 23, 17, 32, 30, 16, 18, 26, 38, 22, 10, 33, 39, 37, 19, 15, 9, 11, 29]
    corner = tokens.space_neighbours(spark.createDataFrame([(0,)], "token long"), 20, 7, 7)
    assert corner.count() == 20
    narrow = tokens.space_neighbours(spark.createDataFrame([(0,), (50,)], "token long"), 20, 1, 100).groupBy("token").count()
    assert {r["token"]: r["count"] for r in narrow.collect()} == {0: 20, 50: 20}
    assert tokens.space_neighbours(spark.createDataFrame([(2,)], "token long"), 20, 2, 2).count() == 3


def test_vectors(spark):
    u, v = (F.array(*map(F.lit, x)) for x in ([3.0, 4.0], [4.0, 3.0]))
    assert value(spark, geo.l2(u, v)) == pytest.approx(math.sqrt(2))
    assert value(spark, geo.cosine_distance(u, v)) == pytest.approx(1 - 24 / 25)
    assert value(spark, geo.cosine_distance(u, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_attention():
    from pathloom.operators.embed import EncoderWeights, attention, encode

    assert attention(np.array([0.3, -1.0, 2.0]), 0).sum() == pytest.approx(1)
    assert attention(np.array([0.0, 0.0]), 1) == pytest.approx([1 / math.sqrt(2)] * 2)
    w = EncoderWeights.seeded(4, 6, 3)
    assert encode(np.ones((3, 5, 4)), w).shape == (3, 6)


def test_encoder_by_hand():
    """Two points, one number each: point t goes in by its own weight, not by the sum of all."""
    from pathloom.operators.embed import EncoderWeights, encode

    one = lambda *v: np.array(v, float)
    w = EncoderWeights(np.array([[0.5], [-0.25]]), one(1.0)[:, None], one(2.0), one(0.1, 0.2, 0.3, 0.4)[None], one(0.5, 0.6, 0.7, 0.8)[None], one(0.01, 0.02, 0.03, 0.04))
    points = [1.0, -2.0]
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    h = c = 0.0
    for t in range(2):
        scores = [2.0 * math.tanh(0.5 * h - 0.25 * c + p) for p in points]
        weight = math.exp(scores[t]) / sum(map(math.exp, scores)) ** (1 / (t + 1))
        x = weight * points[t]
        i, f, g, o = (a * x + b * h + d for a, b, d in zip((0.1, 0.2, 0.3, 0.4), (0.5, 0.6, 0.7, 0.8), (0.01, 0.02, 0.03, 0.04), strict=True))
        c = sigmoid(f) * c + sigmoid(i) * math.tanh(g)
        h = sigmoid(o) * math.tanh(c)
    other = np.array([[points], [[5.0, 0.5]]]).reshape(2, 2, 1)  # trajectories of a batch don't touch one another
    assert encode(other, w)[0] == pytest.approx([h])
