"""Operators on small tables: known results, invariants and brute force."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import keywords, tokens
from pathloom.operators import blocks, cells, embed, evaluate, knn, perturb, segment, simjoin, trajectory
from pathloom.plans import params
from pathloom.plans.queries import QUERIES, fast6
from pathloom.plans.tables import asked, event_points, line_points, order_points, vectors
from pathloom.sources import readers, writers
from tests.sql import SF

POINTS = "tid long, pid long, ts long, x double, y double, terms array<string>"


def test_similarity_known_value(spark):
    p = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, ["a", "b"]), (1, 2, 0, 1.0, 1.0, []), (2, 1, 0, 0.0, 1.0, ["a"]), (2, 2, 0, 3.0, 3.0, ["c"]), (2, 3, 0, 1.0, 0.0, [])], POINTS)
    pairs = spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "qid long, tid long")
    got = {(r["qid"], r["tid"]): r["sim"] for r in simjoin.verify(pairs, p, p, 0.5, 1.0).collect()}
    assert got[1, 2] == pytest.approx(1.0918381087)
    assert got[2, 1] == pytest.approx(got[1, 2])
    assert got[1, 1] == pytest.approx(2.0)
    nested = trajectory.assemble(p)
    form = nested.alias("a").join(nested.alias("b"), F.lit(True)).select(F.col("a.tid").alias("q"), F.col("b.tid").alias("t"), simjoin.similarity(F.col("a.pts"), F.col("b.pts"), 0.5, 1.0).alias("s"))
    for r in form.collect():
        if (r["q"], r["t"]) in got:
            assert r["s"] == pytest.approx(got[r["q"], r["t"]])


@pytest.mark.parametrize("points, alpha, gamma, grid", [(line_points, 0.5, 0.05, 5.0), (line_points, 0.8, 0.5, 1.0), (order_points, 0.5, 0.01, 25.0)])
def test_bounds_hold(spark, points, alpha, gamma, grid):
    p = points(spark, SF)
    pairs = simjoin.candidates(asked(p), p)
    exact = simjoin.verify(pairs, asked(p), p, alpha, gamma)
    bounds = simjoin.trajectory_bounds(pairs, asked(p), p, alpha, gamma, grid)
    both = exact.join(bounds, ["qid", "tid"])
    assert both.count() == pairs.count()
    assert both.where("bound < sim - 1e-9").count() == 0


def test_pruned_equals_unpruned(spark):
    p = line_points(spark, SF)
    a = simjoin.semantic_topk(asked(p), p, 5, 0.9, 0.5).collect()
    b = simjoin.semantic_topk_pruned(asked(p), p, 5, 0.9, 0.5, 5.0).collect()
    key = lambda rows: sorted((r["qid"], r["rank"], r["tid"], round(r["sim"], 9)) for r in rows)
    assert key(a) == key(b)


def test_greedy_batches_stay_small(spark):
    p = order_points(spark, SF)
    batches = simjoin.greedy_batches(p, 400.0)
    assert batches.count() == trajectory.postings(p).count()
    boxed = simjoin.batch_summaries(batches, p, ("kw", "batch"))
    alone = boxed.where("members > 1 AND sqrt(pow(max_x - min_x, 2) + pow(max_y - min_y, 2)) > 400")
    assert alone.count() == 0


def test_greedy_batches_against_fold(spark):
    """Where all boxes lie in one square, the batches of the single fold."""
    p = order_points(spark, SF).where("tid < 60")
    held, want = {}, {}
    for r in trajectory.postings(p).join(trajectory.boxes(p), "tid").orderBy("kw", "tid").collect():
        group = held.setdefault(r["kw"], [])
        grown = [(min(b[0], r["min_x"]), min(b[1], r["min_y"]), max(b[2], r["max_x"]), max(b[3], r["max_y"]), b[4]) for b in group]
        diagonals = [((g[2] - g[0]) ** 2 + (g[3] - g[1]) ** 2) ** 0.5 for g in grown]
        at = min(range(len(group)), key=diagonals.__getitem__, default=-1)
        if at >= 0 and diagonals[at] <= 400:
            group[at] = grown[at]
        else:
            at = len(group)
            group.append((r["min_x"], r["min_y"], r["max_x"], r["max_y"], r["tid"]))
        want[r["kw"], r["tid"]] = group[at][4]
    assert {(r["kw"], r["tid"]): r["batch"] for r in simjoin.greedy_batches(p, 400.0, 1e6).collect()} == want


def test_long_boxes_are_not_folded(spark, monkeypatch):
    """A box longer than the limit can join nothing, so no fold sees it."""
    folded = []
    fold = simjoin._folded
    monkeypatch.setattr(simjoin, "_folded", lambda boxes, *how: folded.append(boxes.count()) or fold(boxes, *how))
    rows = [(t, t * 2 + e, float(t % 7 + e * (50 if t % 4 else 1)), 0.0, ["a"]) for t in range(200) for e in (0, 1)]
    p = spark.createDataFrame(rows, "tid long, pid long, x double, y double, terms array<string>")
    got = {r["tid"]: r["batch"] for r in simjoin.greedy_batches(p, 20.0).collect()}
    assert max(folded) == 50 and got == {t: t if t % 4 else 0 for t in range(200)}


def test_candidates_are_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "SETS", 50)
    rng = np.random.default_rng(4)
    words = [None, *"abcdefghijkl"]
    rows = [(t if t else None, t, 0.0, 0.0, [words[w] for w in rng.integers(0, 13, rng.integers(0, 4))] if t % 9 else None) for t in range(300) for _ in range(2)]
    p = spark.createDataFrame(rows, "tid long, pid long, x double, y double, terms array<string>").repartition(5)
    want = {r["qid"]: r["count"] for r in simjoin.candidates(p.where("tid % 5 = 0"), p).where("tid IS NOT NULL").groupBy("qid").count().collect()}
    assert {r["qid"]: r["n"] for r in simjoin.candidate_counts(p.where("tid % 5 = 0"), p).collect()} == want


def test_lists_of_frequent_and_rare_words():
    """Counts of unions of bits and places, at sizes that don't fill the last bits."""
    rng = np.random.default_rng(5)
    for many in (1, 63, 64, 65, 1000):
        sets = [np.unique(np.append(rng.zipf(1.3, rng.integers(1, 6)), 7_000 + i // 5)) for i in range(many)]
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        lists = simjoin.Lists(np.array([len(x) for x in sets], "<i4"), words, at)
        assert many < 1000 or lists.bits and lists.places
        for q in [[], [-1], *(x.tolist() for x in sets[:20]), *(rng.choice(words, 3).tolist() for _ in range(20))]:
            assert lists.count(q) == sum(bool(set(q) & set(x.tolist())) for x in sets)


def test_queries_are_sent_to_few_blocks(spark, monkeypatch):
    """Each block gets all queries, so however many sets and partitions there are, blocks are few and large."""
    sent = []
    monkeypatch.setattr(simjoin, "every_pair", lambda asked_, blocks_: sent.append(blocks_.count()) or blocks.every_pair(asked_, blocks_))
    for name, n in (("SETS", 20), ("MOST_SETS", 100), ("FEW_BLOCKS", 2)):
        monkeypatch.setattr(simjoin, name, n)
    p = spark.createDataFrame([(t, t, 0, 0.0, 0.0, ["abc"[t % 3], "de"[t % 2]]) for t in range(300)], POINTS).repartition(9, "tid")
    got = {r["qid"]: r["n"] for r in simjoin.candidate_counts(p.where("tid % 20 = 0"), p).collect()}
    assert sent == [3] and got == {t: 200 for t in range(0, 300, 20)}


def test_batches_over_borders(spark):
    """No two batches of a keyword that fit together stay apart, wherever borders lie; ties and odd rows."""
    rng = np.random.default_rng(14)
    rows = [(i, 0, 0, float(x), float(y), ["a"] if i % 3 else ["a", "b"]) for i, (x, y) in enumerate(rng.integers(-40, 40, (300, 2)))] + [(900, 0, 0, None, None, ["a"]), (901, 0, 0, 1.0, 1.0, None), (902, 0, 0, 1.0, 1.0, [])]
    p = spark.createDataFrame(rows, POINTS)
    batches = simjoin.greedy_batches(p, 6.0, 4.0).collect()
    assert len(batches) == 300 + 100
    boxes = {}
    for r in batches:
        x, y = rows[r["tid"]][3:5]
        b = boxes.get((r["kw"], r["batch"]), (x, y, x, y))
        boxes[r["kw"], r["batch"]] = (min(b[0], x), min(b[1], y), max(b[2], x), max(b[3], y))
    assert all(np.hypot(b[2] - b[0], b[3] - b[1]) <= 6 for b in boxes.values())
    for (k, i), a in boxes.items():
        for (m, j), b in boxes.items():
            if k == m and i < j:
                assert np.hypot(max(a[2], b[2]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[1], b[1])) > 6
    assert simjoin.greedy_batches(p.where("false"), 6.0).count() == 0


def test_greedy_batches_folds_most_boxes(spark):
    """The query's limit lets boxes of orders, which span years, join one another."""
    batches = QUERIES["greedy_batches"](spark, SF)
    assert batches.count() == trajectory.postings(order_points(spark, SF)).count() > 5 * batches.select("kw", "batch").distinct().count()


@pytest.mark.parametrize("spread", [3, 400])
def test_closest_cells(spark, spread):
    rng = np.random.default_rng(spread)
    cells_ = sorted({(int(t), int(x), int(y)) for t, x, y in zip(rng.integers(0, 60, 200), rng.integers(-spread, spread, 200), rng.integers(-spread, spread, 200), strict=True)} | {(70, 5000, -5000)})
    df = spark.createDataFrame([*cells_, (None, 1, 1), (20, None, 1)], "tid long, cx int, cy int")
    want = []
    of = {}
    for t, x, y in cells_:
        of.setdefault(t, []).append((x, y))
    for q in (t for t in of if t % 10 == 0):
        each = sorted((round(min(np.hypot(max(0, abs(a - c) - 1), max(0, abs(b - d) - 1)) for a, b in of[q] for c, d in of[t]), 9), t) for t in of)[:7]
        want += [(q, r, t, float(d)) for r, (d, t) in enumerate(each, 1)]
    got = simjoin.closest_cells(df.where("tid % 10 = 0"), df, 7).collect()
    assert sorted((r["qid"], r["rank"], r["tid"], round(r["distance"], 9)) for r in got) == sorted(want)
    assert simjoin.closest_cells(df.where("false"), df, 3).count() == 0 and simjoin.closest_cells(df, df.where("false"), 3).count() == 0
    assert simjoin.closest_cells(df.where("tid = 70"), df, 100).count() == len(of)


ITEMS = [(1, [0.0110, 0.2341]), (2, [0.2300, 0.3891]), (3, [0.4300, 0.9891]), (4, [0.9999, 0.9999])]


def test_closest_cells_of_a_crowd(spark):
    """Of a crowded cell only k trajectories meet a query, and they are those that brute force finds."""
    df = spark.range(400).select(F.col("id").alias("tid"), (F.col("id") % 3).cast("int").alias("cx"), F.lit(0).alias("cy"))
    assert {r["n"] for r in simjoin.first_of_cells(df, 5).groupBy("cx").agg(F.count("*").alias("n")).collect()} == {5}
    got = {}
    for r in simjoin.closest_cells(df.where("tid % 20 = 0"), df, 5).orderBy("rank").collect():
        got.setdefault(r["qid"], []).append((r["distance"], r["tid"]))
    assert got == {q: sorted((float(max(0, abs(q % 3 - t % 3) - 1)), t) for t in range(400))[:5] for q in range(0, 400, 20)}


def test_knn_known_values(spark):
    v = spark.createDataFrame(ITEMS, "id long, vec array<double>")
    got = knn.knn_exact(v.where("id = 2"), v, 10).orderBy("rank").collect()
    assert [(r["id"]) for r in got] == [2, 1, 3, 4]
    assert [r["dist"] for r in got] == pytest.approx([0, 0.26830205, 0.6324555, 0.98276275], abs=1e-6)
    three = v.where("id < 4")
    got = knn.knn_exact(v.where("id = 1"), three, 10, "cosine").orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3, 2]
    assert [r["dist"] for r in got] == pytest.approx([0, 0.0652127, 0.1162131], abs=1e-6)
    got = knn.knn_exact(v.where("id = 1"), three, 10, "cosine", with_self=False).orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 2]


def test_cells(spark, tmp_path):
    """Recall and the share read on clustered vectors; all cells give exact search; partitions are pruned; a hot cell is many blocks."""
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 10, (20, 8))
    points = np.concatenate([middles[rng.integers(0, 20, 2000)], np.tile(middles[:1], (1000, 1))]) + rng.normal(0, 1, (3000, 8))
    v = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)] + [(None, [0.0] * 8, 1), (9001, None, 1), (9002, [float("nan")] * 8, 1)], "id long, vec array<double>, cell int")
    q, how = asked(v, "id"), params.CellParams(cells=20, probes=3, sample=500)
    for metric in ("l2", "cosine"):
        path = str(tmp_path / metric)
        cells.build(v, path, how, metric)
        truth = knn.knn_exact(q, v, 10, metric)
        found = cells.search(q, path, 10, 3, metric)
        assert knn.recall(found, truth).first()["recall"] > 0.95
        shares = cells.shares_read(q, path, 3, metric).agg(F.avg("share"), F.count("*")).first()
        assert 0 < shares[0] < 0.5 and shares[1] == 150
        key = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["dist"], 9)) for r in df.collect())
        assert key(cells.search(q, path, 10, 20, metric)) == key(truth)
        assert key(cells.search(q, path, 3, 20, metric, with_self=False)) == key(knn.knn_exact(q, v, 3, metric, with_self=False))
    one = q.where("id = 40")
    assert cells.search(one, path, 10, 1).count() == 10
    assert cells.search(q.where("false"), path, 10).count() == 0
    cells.build(v.where("false"), path)
    assert cells.search(q, path, 10).count() == 0
    assert cells.knn_approx(q, v, 10, how).count() == 10 * 150


def test_vectors_that_cannot_be_compared(spark):
    """Null, NaN, infinite and zero vectors beside healthy ones, by brute force, with ties and repeated ids."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(0, 3, 3).astype(float).tolist()) for i in range(60)] + [(7, [1.0, 1.0, 1.0]), (100, [0.0, 0.0, 0.0]), (120, [0.0, 0.0, 0.0])]
    bad = [(200, None), (220, [float("nan"), 1.0, 1.0]), (201, [None, 1.0, 1.0]), (202, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (240, [-float("inf")] * 3)]
    v = spark.createDataFrame(rows + bad, "id long, vec array<double>").repartition(3)
    for metric in ("l2", "cosine"):
        for k, with_self in ((5, True), (70, True), (4, False)):
            want = []
            for q, x in rows:
                if q % 20 == 0:
                    d = knn.distances(np.array([x]), np.array([y for _, y in rows]), metric)[0]
                    each = sorted((np.inf if np.isnan(e) else round(float(e), 9), i) for e, (i, _) in zip(d, rows, strict=True) if with_self or i != q)[:k]
                    want += [(q, r, i, None if e == np.inf else e + 0.0) for r, (e, i) in enumerate(each, 1)]
            got = [(r["qid"], r["rank"], r["id"], None if r["dist"] is None else round(r["dist"], 9) + 0.0) for r in knn.knn_exact(asked(v, "id"), v, k, metric, with_self).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want))
    near = lambda df: sorted((r["qid"], r["rank"], r["id"]) for r in df.collect())
    assert near(knn.knn_pivot_pruned(asked(v, "id"), v, 5)) == near(knn.knn_exact(asked(v, "id"), v, 5))
    assert knn.knn_exact(v.where("id = 200"), v, 5).count() == 0
    ragged = v.union(spark.createDataFrame([(300, [1.0])], "id long, vec array<double>"))
    with pytest.raises(Exception, match="vector of other length"):
        knn.knn_exact(asked(v, "id"), ragged, 5).collect()


@pytest.mark.parametrize("block", [4, 1024])
def test_extremes(spark, block, monkeypatch):
    monkeypatch.setattr(knn, "EXTREME_BLOCK", block)
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in (0, 50, 51, 900)] + [np.ones((3, 3)) * 7])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(None, [0.0] * 3), (500, None), (501, [float("nan")] * 3)]
    v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))[np.triu_indices(len(points), 1)]
    got = knn.extremes(v, 3).first()
    assert (got["min_dist"], got["max_dist"], got["equal_pairs"]) == (0.0, pytest.approx(d.max()), 3)
    assert got["pairs"] == len(d) if block > 1000 else got["pairs"] < 0.5 * len(d)
    apart = knn.extremes(v.where("id < 160")).first()
    assert apart["min_dist"] == pytest.approx(d[d > 0].min()) and apart["equal_pairs"] == 0
    for few in (v.where("false"), v.where("id = 3"), v.where("id > 400")):
        assert tuple(knn.extremes(few).first()) == (0, None, None, 0)


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e200])
def test_extremes_by_products(spark, shift):
    """Matrix products only choose the pairs: far from the origin, and where squares overflow, extremes are exact all the same."""
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (300, 8)) + shift
    points[17] = points[130]
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>").repartition(4)
    d = knn.distances(points, points, "l2")[np.triu_indices(300, 1)]
    got = knn.extremes(v, 3).first()
    assert (got["min_dist"], got["max_dist"], got["equal_pairs"]) == (d.min(), d.max(), int((d == 0).sum()))
    near = sorted((r["qid"], r["rank"], r["id"]) for r in knn.knn_exact(v.where("id % 20 = 0"), v, 4).collect())
    assert near == sorted((q, r, i) for q in range(0, 300, 20) for r, (_, i) in enumerate(sorted((round(float(e), 12), i) for i, e in enumerate(knn.distances(points[[q]], points, "l2")[0]))[:4], 1))


def test_squares_hold_their_bound():
    """The squares that choose pairs are off by no more than they say, and pairs are measured as all are."""
    rng = np.random.default_rng(6)
    for scale in (1e-3, 1.0, 1e5):
        a, b = rng.normal(scale, scale, (50, 64)), rng.normal(scale, scale, (70, 64))
        exact = knn.distances(a, b, "l2")
        about, off = knn.squares(a, b)
        assert np.abs(about - exact**2).max() <= off
        i, j = np.nonzero(exact > 0)
        assert (knn.pair_distances(a, b, i, j) == exact[i, j]).all()


def test_pivots_prune(spark):
    rng = np.random.default_rng(8)
    points = rng.integers(0, 10, (3000, 3)) * 100 + rng.random((3000, 3))
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vec array<double>")
    asked_ = v.where("id % 200 = 0")
    key = lambda df: sorted((r["qid"], r["rank"], r["id"]) for r in df.collect())
    assert key(knn.knn_pivot_pruned(asked_, v, 5)) == key(knn.knn_exact(asked_, v, 5))
    costs = {r["qid"]: r["compared"] for r in knn.pivot_costs(asked_, v, 5).collect()}
    assert len(costs) == 15 and sum(costs.values()) < 0.5 * 15 * 3000
    assert knn.knn_pivot_pruned(asked_, v.where("false"), 5).count() == 0


def test_bounds_spare_comparisons(spark):
    from pathloom.operators import simsearch

    p = line_points(spark, SF)
    few = simsearch.verified_pairs(asked(p), p, 5, 0.9, 0.5, 5000.0).agg(F.sum("verified")).first()[0]
    every = simsearch.verified_pairs(asked(p), p, 5, 0.9, 0.5, 5000.0, prune=False).agg(F.sum("verified")).first()[0]
    assert every == simjoin.candidates(asked(p), p).count()
    assert few < every
    assert simsearch.topk(asked(p), p.where("false"), 5).count() == 0
    assert simsearch.topk(asked(p).where("false"), p, 5).count() == 0


def test_search_with_odd_keywords(spark):
    """Points without keywords, repeated keywords, ties, and trajectories that share none."""
    rows = [(1, 1, 0, 0.0, 0.0, ["a", "a", "b"]), (1, 2, 0, 1.0, 1.0, []), (2, 1, 0, 0.0, 1.0, ["a"]), (3, 1, 0, 0.0, 1.0, ["a"]), (4, 1, 0, 0.0, 0.0, ["z"]), (5, 1, 0, 9.0, 9.0, []), (20, 1, 0, 5.0, 5.0, ["b"])]
    p = spark.createDataFrame(rows, POINTS)
    for prune in (True, False):
        from pathloom.operators import simsearch

        got = [(r["qid"], r["rank"], r["tid"]) for r in simsearch.topk(p.where("tid in (1, 5)"), p, 3, 0.5, 1.0, 10.0, prune).orderBy("qid", "rank").collect()]
        assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_search_with_gaps(spark):
    """Points without a place, null keywords and rows without an id: both forms find what brute force over the other points finds."""
    from pathloom.operators import simsearch

    rng = np.random.default_rng(12)
    rows = []
    for tid in range(60):
        for pid in range(5):
            y = [float(rng.integers(0, 40)), None, float("nan"), float("inf")][int(rng.choice(4, p=[0.8, 0.1, 0.05, 0.05]))]
            terms = [["a"], ["a", "b"], [], None, ["b", None]][int(rng.integers(0, 5))]
            rows.append((tid, pid, 0, float(rng.integers(0, 40)), y, terms))
    rows += [(100, 0, 0, None, None, ["a"]), (None, 0, 0, 1.0, 1.0, ["a"]), (101, 0, 0, 1.0, 1.0, None)]
    p = spark.createDataFrame(rows, POINTS).repartition(3)
    fine = {}
    for tid, _, _, x, y, terms in rows:
        if tid is not None and x is not None and y is not None and np.isfinite(y):
            fine.setdefault(tid, []).append((x, y, {t for t in terms or [] if t}))

    def one_way(a, b):
        return np.mean([max(0.5 * (2 - 2 / (1 + np.exp(-0.1 * np.hypot(x - u, y - v)))) + 0.5 * (len(s & t) / len(s | t) if s | t else 1) for u, v, t in b) for x, y, s in a])

    want = []
    for q in (t for t in fine if t % 20 == 0):
        words = set().union(*(s for *_, s in fine[q]))
        each = sorted((-round(one_way(fine[q], d) + one_way(d, fine[q]), 9), t) for t, d in fine.items() if words & set().union(*(s for *_, s in d)))[:5]
        want += [(q, r, t, -s) for r, (s, t) in enumerate(each, 1)]
    for prune in (True, False):
        got = [(r["qid"], r["rank"], r["tid"], round(r["sim"], 9)) for r in simsearch.topk(asked(p), p, 5, 0.5, 0.1, 10.0, prune).collect()]
        assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(want)]
        assert [x[3] for x in sorted(got)] == pytest.approx([x[3] for x in sorted(want)], abs=1e-8)


@pytest.mark.parametrize("words", [0, 1, 3])
@pytest.mark.parametrize("prune", [True, False])
def test_few_are_verified_exactly(monkeypatch, prune, words):
    """Single precision picks those that may be among the k best: within its error of the exact values, ties too, and few are compared twice."""
    from pathloom.operators import simsearch

    rng = np.random.default_rng(21)
    sizes = rng.integers(1, 40, 500).astype("<i4")
    n = rng.integers(0, words + 1, sizes.sum()).astype("<i4")
    h = np.concatenate([np.sort(rng.choice(5, k, replace=False)) for k in n]).astype("<i8")
    flat = {"ids": np.arange(500, dtype="<i8"), "sizes": sizes, "x": rng.uniform(0, 500, len(n)), "y": np.floor(rng.uniform(0, 100, len(n))), "n": n, "h": h}
    block = simsearch.Block({c: v.tobytes() for c, v in flat.items()})
    monkeypatch.setattr(simsearch, "CELLS", 20_000)
    for i in range(5):
        query = simsearch.Query(block.one(i), block, 0.6, 0.05)
        exact = query.verified(np.arange(500))
        near, error = query.single(np.arange(500))
        assert np.abs(near - exact).max() < error < 1e-3
        seen = []
        monkeypatch.setattr(query, "verified", lambda members, query=query: seen.append(len(members)) or simsearch.Query.verified(query, members))
        members, sims, threshold, compared = simsearch.search(query, 10, -np.inf, prune)
        shares = np.flatnonzero(query.shares)
        best = np.sort(exact[shares])[::-1][:10]
        assert sorted(sims)[::-1][:10] == pytest.approx(best) and (not len(best) or threshold == pytest.approx(best[-1]) or len(best) < 10)
        assert compared == len(shares) and sum(seen) <= max(10, len(shares) // 5)


def test_short_trajectories_are_searched_together(monkeypatch):
    """The joint search of a query block finds what each query finds alone; blocks of other points have none."""
    from pathloom.operators import simsearch

    rng = np.random.default_rng(22)

    def block(many, words=1):
        sizes = rng.integers(1, 6, many).astype("<i4")
        n = np.full(sizes.sum(), words, "<i4")
        flat = {"ids": np.arange(many, dtype="<i8"), "sizes": sizes, "x": rng.uniform(0, 1e5, len(n)), "y": rng.integers(1, 51, len(n)).astype("<f8"), "n": n, "h": rng.integers(0, 30, words * len(n)).astype("<i8")}
        return simsearch.Block({c: v.tobytes() for c, v in flat.items()})

    data, asking = block(400), block(20)
    monkeypatch.setattr(simsearch, "CELLS", 1_000)
    for prune, start in ((True, -np.inf), (True, 1.2), (False, -np.inf), (True, 5.0)):
        thresholds = np.full(20, start)
        members, sims, counts = simsearch.search_few(asking, data, 10, 0.9, 0.001, thresholds, prune)
        for i in range(20):
            alone, found, threshold, _ = simsearch.search(simsearch.Query(asking.one(i), data, 0.9, 0.001), 10, start, prune)
            assert sorted(members[i]) == sorted(alone) and sorted(sims[i]) == pytest.approx(sorted(found), abs=1e-12) and thresholds[i] == pytest.approx(threshold, abs=1e-12)
        assert prune or counts.tolist() == [int(simsearch.Query(asking.one(i), data, 0.9, 0.001).shares.sum()) for i in range(20)]
    assert simsearch.search_few(asking, block(9, 2), 10, 0.9, 0.001, np.full(20, -np.inf), True) is None


def test_blocks_by_points(spark, monkeypatch):
    from pathloom.operators import simsearch

    monkeypatch.setattr(simsearch, "POINTS", 10)
    rows = [(t, [1.0] * k, [1.0] * k, [0] * k, []) for t, k in enumerate([3, 4, 30, 1, 9, 1, 2])]
    packed = simsearch.pack(spark.createDataFrame(rows, "tid long, x array<double>, y array<double>, n array<int>, h array<long>").coalesce(1), 4)
    assert [np.frombuffer(r["ids"], "<i8").tolist() for r in packed.collect()] == [[0, 1], [2], [3, 4], [5, 6]]


def test_knn_over_shuffled_rows(spark):
    """Data from a shuffle whose partitions are coalesced in one job and not in another: no row is lost."""
    small = {"advisoryPartitionSizeInBytes": "48k", "coalescePartitions.parallelismFirst": "false", "coalescePartitions.minPartitionSize": "1k"}
    for name, value in small.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        points = np.random.default_rng(3).random((2000, 16))
        rows = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(points)], "id long, vec array<double>, version long")
        data = knn.upsert(rows, rows.limit(0))
        found = knn.knn_exact(rows.where("id % 500 = 0"), data, 10).collect()
        every = knn.knn_exact(rows.where("id = 0"), data, 2000).count()
        near = cells.knn_approx(rows.where("id = 0"), data, 10).count()
    finally:
        for name in small:
            spark.conf.unset(f"spark.sql.adaptive.{name}")
    for q in range(0, 2000, 500):
        want = np.argsort(np.sqrt(((points - points[q]) ** 2).sum(axis=1)), kind="stable")[:10]
        assert [r["id"] for r in sorted((r for r in found if r["qid"] == q), key=lambda r: r["rank"])] == want.tolist()
    assert every == 2000 and near == 10


def test_versions(spark):
    v10 = spark.createDataFrame([(1, [0.0], 10)], "id long, vec array<double>, version long")
    new = lambda version: spark.createDataFrame([(1, [1.0], version)], v10.schema)
    assert knn.upsert(v10, new(11)).first()["vec"] == [1.0]
    assert knn.upsert(v10, new(9)).first()["vec"] == [0.0]
    gone = lambda i, version: spark.createDataFrame([(i, version)], "id long, version long")
    assert knn.remove(v10, gone(1, 9)).count() == 1
    assert knn.remove(v10, gone(1, 10)).count() == 0
    assert [knn.removal_results(v10, gone(*x)).first()["removed"] for x in ((2, 10), (1, 9), (1, 10))] == [False, False, True]
    with pytest.raises(Exception, match="other length"):
        knn.check_dimensions(v10, 2).collect()


def brute_segments(rows, gap, most, least):
    out, state = [], None
    for ts, x, y in rows:
        if state is None or ts - state["last"] >= gap or len(state["kept"]) >= most:
            state = {"kept": [(x, y)]}
            out.append(state)
        elif x != state["xy"][0] and y != state["xy"][1]:
            state["kept"].append((x, y))
        state["last"], state["xy"] = ts, (x, y)
    return [len(s["kept"]) for i, s in enumerate(out) if len(s["kept"]) >= least or i == len(out) - 1]


def test_segments_against_fold(spark):
    rng = np.random.default_rng(5)
    rows, t = [], 0
    for i in range(600):
        t += int(rng.choice([10, 20, 100]))
        rows.append((1, i, t, float(rng.integers(0, 4)), float(rng.integers(0, 4))))
    df = spark.createDataFrame(rows, "file long, line long, t long, x double, y double").withColumn("ts", F.timestamp_seconds("t"))
    got = segment.segment(df, 100.0, max_points=7, min_points=3, min_metres=0.0).groupBy("seg").count().orderBy("seg").collect()
    assert [r["count"] for r in got] == brute_segments([(t, x, y) for _, _, t, x, y in rows], 100, 7, 3)
    assert [r["seg"] for r in got] == list(range(len(got)))


def test_gap_at_threshold_splits(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 100), (1, 3, 199)], "file long, line long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r["seg"] for r in segment.gap_segments(df, 100.0).orderBy("line").collect()] == [0, 1, 1]


@pytest.mark.parametrize("order", [("ts", "line"), ("line",)])
def test_gaps_over_pieces_of_a_log(spark, order):
    rng = np.random.default_rng(2)
    times = np.cumsum(rng.choice([60, 3600, 90_000, 200_000], 400, p=[0.5, 0.3, 0.1, 0.1])).tolist()
    rows = [(k, i * 9000, t) for k in (1, None) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "file long, line long, t long").withColumn("ts", F.timestamp_seconds("t"))
    want = [0, *np.cumsum(np.diff(times) >= 3600).tolist()]
    got = segment.gap_segments(df, 3600.0, order=order).orderBy("file", "line").collect()
    assert [r["seg"] for r in got] == want + want


def test_dedupe_drops_moves_along_one_axis(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 2.0, 2.0), (1, 4, 2.0, 2.0)], "tid long, pid long, x double, y double")
    assert [r["pid"] for r in trajectory.dedupe_moves(df).orderBy("pid").collect()] == [1, 3]


def test_sampling(spark):
    p = event_points(spark, SF)
    assert trajectory.sample(p, 2.0).count() == 2 * p.count()
    assert trajectory.sample(p, 0.0).count() == p.count()
    assert trajectory.sample_queries(p, 4).select("tid").distinct().count() == 4
    assert trajectory.sub_trajectory(p, 5).groupBy("tid").count().agg(F.max("count")).first()[0] == 5


def test_noise(spark):
    p = event_points(spark, SF)
    n = p.groupBy("tid").count()
    kept = perturb.drop_points(p, 0.3).groupBy("tid").agg(F.count("*").alias("kept")).join(n, "tid")
    assert kept.where("kept != round(count * 0.7)").count() == 0
    t = trajectory.assemble(p.select("tid", "pid", "x", "y"))
    moved = perturb.shift_points(t, 3).join(t.select("tid", F.col("pts").alias("was")), "tid")
    for r in moved.collect():
        assert sorted(r["pts"]) == sorted(r["was"])
    # Three points, width 3: at place 1 the offset is (7 * 7919 + 104729) % 1000003 % 3 - 1 = 0, with seed 1 it is 1.
    three = spark.createDataFrame([(7, [(1, 0.0), (2, 0.0), (3, 0.0)])], "tid long, pts array<struct<pid:long,x:double>>")
    assert [p["pid"] for p in perturb.shift_points(three, 3).first()["pts"]] == [1, 2, 3]
    assert [p["pid"] for p in perturb.shift_points(three, 3, seed=1).first()["pts"]] == [1, 3, 2]
    words = spark.createDataFrame([("new",)], "term string")
    assert perturb.substitute_terms(p, words, 1.0).where("terms != array('new')").count() == 0
    assert perturb.substitute_terms(p, words, 0.0).join(p, ["tid", "pid"]).count() == p.count()


def test_precision(spark):
    truth = spark.createDataFrame([(1, r, t) for r, t in enumerate([10, 11, 12, 13], 1)], "qid long, rank int, tid long")
    found = spark.createDataFrame([(1, r, t) for r, t in enumerate([1, 11, 13, 10], 1)], "qid long, rank int, tid long")
    row = evaluate.precision_at_k(found, truth, [2]).first()
    assert (row["precision"], row["recall"]) == (0.5, 1.0)
    assert evaluate.averages(evaluate.precision_at_k(found, truth, [1, 2, 3])).count() == 3
    assert evaluate.intersections(found, truth).first()["shared"] == 3


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1\t1000\t1.5\t2.5\ta,b\n1\t2000\t2.5\t3.5\t\n2\t1500\t0.0\t0.0\tc\n")
    p = readers.read_points_tsv(spark, str(tmp_path / "p.tsv"))
    rows = p.orderBy("pid").collect()
    assert [(r["tid"], r["ts"], r["x"], r["terms"]) for r in rows] == [(1, 1000, 1.5, ["a", "b"]), (1, 2000, 2.5, []), (2, 1500, 0.0, ["c"])]
    writers.write_queries(p, spark.createDataFrame([(1,)], "tid long"), str(tmp_path / "q"))
    assert readers.read_points_tsv(spark, str(tmp_path / "q")).count() == 2
    (tmp_path / "gps/a").mkdir(parents=True)
    (tmp_path / "gps/a/1.csv").write_text("7,2020-01-01 00:00:00,1.0,2.0\n7,no date,1.0,2.0\n")
    g = readers.read_gps_folder(spark, str(tmp_path / "gps")).orderBy("line").collect()
    assert [r["ts"] is None for r in g] == [False, True]
    (tmp_path / "v.txt").write_text("w 1 2\nu 3 4\n")
    assert [(r["name"], r["vec"]) for r in readers.read_vectors(spark, str(tmp_path / "v.txt"), " ", True).orderBy("id").collect()] == [("w", [1.0, 2.0]), ("u", [3.0, 4.0])]
    (tmp_path / "truth.txt").write_text("100 200\n5\n6\n1,0.9 2,0.8\n3,0.9 4,0.8\n5,0.9 6,0.8\n7,0.9 8,0.8\n")
    t = {(r["qid"], r["ds_size"], r["rank"]): r["tid"] for r in readers.read_ground_truth(spark, str(tmp_path / "truth.txt"), 2).collect()}
    assert t == {(q, s, k): i for i, (q, s, k) in enumerate(itertools.product((5, 6), (100, 200), (1, 2)), 1)}
    writers.write_gps_lines(p, str(tmp_path / "out"), 1)
    assert spark.read.csv(str(tmp_path / "out")).count() == 2
    e = readers.extent(p).first()
    assert (e["min_ts"], e["max_x"]) == (1000, 2.5)


def test_line_numbers(spark, tmp_path):
    """Dense, from 0, in the order of files and lines, however files are cut; chunks by position."""
    (tmp_path / "t").mkdir()
    lines = {f"{c}.txt": [f"{c}{k}" + "x" * (k % 50) if k % 9 else "" for k in range(n)] for c, n in (("a", 400), ("b", 3), ("c", 900), ("d", 0))}
    for name, own in lines.items():
        (tmp_path / "t" / name).write_text("".join(f"{x}\n" for x in own))
    every = [x for own in lines.values() for x in own]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = readers.read_lines(spark, str(tmp_path / "t"))
        assert [(r["line"], r["value"]) for r in found.orderBy("line").collect()] == list(enumerate(every))
        (tmp_path / "p.tsv").write_text("".join(f"{k // 7}\t{k}\t{k}.5\t1.0\ta,b\n" for k in range(1000)))
        p = readers.read_points_tsv(spark, str(tmp_path / "p.tsv"))
        assert p.rdd.getNumPartitions() > 1
        assert [(r["pid"], r["ts"]) for r in p.orderBy("pid").collect()] == [(k, k) for k in range(1000)]
        t = readers.by_position(p, 30).orderBy("pts").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["tid"], [x["pid"] for x in r["pts"]]) for r in t] == [(k // 7, list(range(k, min(k + 30, 1000)))) for k in range(0, 1000, 30)]


def test_point_lookup(spark, tmp_path):
    path = str(tmp_path / "v")
    v = spark.createDataFrame([(k, [float(k)]) for k in range(-5, 95)] + [(None, [0.0]), (3, [9.0])], "id long, vec array<double>")
    writers.write_table(v, path, 8)
    assert sorted((r["id"], r["vec"]) for r in writers.get(spark, path, [3, -5, 1000], 8).collect()) == [(-5, [-5.0]), (3, [3.0]), (3, [9.0])]
    assert writers.contains(spark, path, 94, 8) and not writers.contains(spark, path, 95, 8)
    plan = writers.get(spark, path, [3], 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,3)]" in plan


def test_models_are_saved(spark, tmp_path):
    w = embed.EncoderWeights.seeded(6, 5, 4)
    embed.save_weights(spark, embed.EncoderWeights.seeded(6, 5, 4, seed=1), str(tmp_path / "w"), 1)
    embed.save_weights(spark, w, str(tmp_path / "w"), 2)
    rows = spark.createDataFrame([(t, p, np.random.default_rng(10 * t + p).random(6).tolist()) for t in range(4) for p in range(2 + t % 2)] + [(9, 0, None)], "tid long, pid long, feature array<double>")
    made = lambda x: {r["tid"]: r["vec"] for r in embed.encode_trajectories(rows, x).collect()}
    assert made(embed.load_weights(spark, str(tmp_path / "w"))) == made(w) != made(embed.load_weights(spark, str(tmp_path / "w"), 1))
    assert set(made(w)) == {0, 1, 2, 3}
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, vec array<double>")
    embed.save_vectors(v, str(tmp_path / "v"), 10)
    embed.save_vectors(v.limit(0), str(tmp_path / "v"), 9)
    assert sorted(embed.load_vectors(spark, str(tmp_path / "v")).collect()) == sorted(v.collect())


def test_training_in_parts(spark):
    """One part by itself, parts by the number of sentences, a bound on lengths, and nothing to train on."""
    near = tokens.space_neighbours(spark.range(144).select(F.col("id").alias("token")), 8, 12, 12)
    sentences = embed.neighbour_sentences(near)
    for parts, least in ((1, 0.5), (4, 0.5)):
        v = embed.token_vectors(sentences, 16, rounds=12, parts=parts, most=1.0)
        assert embed.neighbour_share(v, near, 8).first()["share"] > least
        assert max(np.linalg.norm(r["vec"]) for r in v.collect()) <= 1 + 1e-9
    empty = spark.createDataFrame([(None,), ([],)], "words array<string>")
    assert embed.token_vectors(empty).count() == 0
    assert embed.token_vectors(sentences.union(empty), 4, rounds=1).count() == 144


def test_encoder_looks_tokens_up(spark):
    """States from tokens are those from point features, and no features are shuffled."""
    rng = np.random.default_rng(3)
    words = ["a b", "c", "d", "unknown"]
    rows = [(t, p, int(rng.integers(0, 6)), None if p == 3 else int(rng.integers(0, 5)), None if p == 1 else [words[i] for i in rng.integers(0, 4, p % 4)]) for t in range(12) for p in range(1 + t % 5)]
    points = spark.createDataFrame(rows, "tid long, pid long, space_token long, time_token long, terms array<string>").repartition(3)
    table = lambda names: spark.createDataFrame([(str(n), rng.normal(0, 1, 4).tolist()) for n in names], "word string, vec array<double>")
    tables = table(range(5)), table(range(4)), table(["a-b", "c", "d"])
    weights = embed.EncoderWeights.seeded(12, 5, 3)
    want = {r["tid"]: r["vec"] for r in embed.encode_trajectories(embed.point_features(points, *tables, 4), weights).collect()}
    got = embed.encode_tokens(points, *tables, weights, 4)
    assert "feature" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r["tid"]: r["vec"] for r in got.collect()}
    assert set(got) == set(want) == set(range(12))
    for tid, vec in want.items():
        assert got[tid] == pytest.approx(vec, abs=1e-9)


def test_losses_by_hand(spark):
    """Two points; labels without a vector or a logit don't count; the strict form differs as it is said to."""
    rng = np.random.default_rng(3)
    names = ["space", "time", "words"]
    vec = {n: {str(k): rng.random(3) for k in range(4)} for n in names}
    true = {(1, p): {n: rng.random(3) for n in names} for p in (0, 1)}
    logit = {(n, p, k): float(rng.normal()) for n in names for p in (0, 1) for k in vec[n]}
    truth = spark.createDataFrame([(t, p, *(x[n].tolist() for n in names)) for (t, p), x in true.items()], "tid long, pid long, space array<double>, time array<double>, words array<double>")
    labels = {n: spark.createDataFrame([(1, p, k) for p in (0, 1) for k in ("0", "2", "3", "none")], "tid long, pid long, label string") for n in names}
    logits = {n: spark.createDataFrame([(1, p, k, x) for (m, p, k), x in logit.items() if m == n], "tid long, pid long, label string, logit double") for n in names}
    vectors_ = {n: spark.createDataFrame([(k, x.tolist()) for k, x in vec[n].items()], "word string, vec array<double>") for n in names}
    for strict in (False, True):
        want = 0.0
        for n in names:
            for p in (0, 1):
                t = true[1, p]["space" if strict else n]
                x = np.array([vec[n][k] for k in ("0", "2", "3")])
                if n == "words":
                    s = x @ t / np.linalg.norm(x, axis=1) / np.linalg.norm(t) * (-1 if strict else 1) / 0.7
                else:
                    s = -np.linalg.norm(x - t, axis=1) / (0.3 if strict or n == "space" else 0.5)
                w = np.exp(s) / np.exp(s).sum()
                ce = np.log(sum(np.exp(logit[n, p, k]) for k in vec[n])) - np.array([logit[n, p, k] for k in ("0", "2", "3")])
                want += (w * ce).sum() / (3 if strict and n != "words" else 1)
        assert embed.sta_loss(truth, labels, logits, vectors_, 0.3, 0.5, 0.7, strict).first()["loss"] == pytest.approx(want)


def test_more_readers_and_writers(spark, tmp_path):
    (tmp_path / "v.csv").write_text("1,2.5\n3,4\n")
    assert [r["vec"] for r in readers.read_vectors(spark, str(tmp_path / "v.csv")).orderBy("id").collect()] == [[1.0, 2.5], [3.0, 4.0]]
    (tmp_path / "k.txt").write_text(" one \n\ntwo words\n")
    assert [r["term"] for r in readers.read_keywords(spark, str(tmp_path / "k.txt")).orderBy("term_id").collect()] == ["one", "two words"]
    a, b = (spark.createDataFrame([(i, [i]) for i in ids], "tid long, pts array<long>") for ids in ((1, 2), (1, 3)))
    assert readers.paired(a, a).where("sampled = complete").count() == 2
    with pytest.raises(Exception, match="one table only"):
        readers.paired(a, b).collect()
    found = spark.createDataFrame([(1, 1, 42, 1.5)], "qid long, rank int, tid long, sim double")
    assert writers.result_lines(found).first()["line"] == "     42 1.50000"
    writers.write_metrics(spark.createDataFrame([(5, 0.5)], "k int, precision double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["precision"] == 0.5
    records = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 4.0)], "name string, n int, x double")
    assert tuple(evaluate.averaged_records(records, "name").first()) == ("a", 2.0, 3.0)
    assert sorted(r["n"] for r in trajectory.shuffled(spark.range(5).withColumnRenamed("id", "n"), "n").collect()) == list(range(5))


def test_live_segments(spark, tmp_path):
    from pathloom.streaming.live import live_segments

    now = 1_700_000_000
    rows = [(1, 0, 0.0, 0.0), (1, 50, 0.1, 0.1), (1, 400, 0.2, 0.2), (2, 10, 1.0, 1.0), (9, 5000, 0.0, 0.0), (3, 6000, 0.0, 0.0), (1, 9000, 0.3, 0.3), (9, 20000, 0.0, 0.0), (9, 30000, 0.0, 0.0)]
    df = spark.createDataFrame([(k, now + t, x, y) for k, t, x, y in rows], "key long, t long, x double, y double").select("key", F.timestamp_seconds("t").alias("ts"), "x", "y")
    for i, (low, high) in enumerate(((0, 500), (500, 5500), (5500, 8000), (8000, 15000), (15000, 25000), (25000, 40000))):
        df.where(f"ts >= timestamp_seconds({now + low}) AND ts < timestamp_seconds({now + high})").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_segments(stream, 300.0).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [((r["key"], r["seg"]), r["n_points"]) for r in spark.table("segs").collect()]
    # Key 1 ends its second segment by the watermark; what comes later has a number of its own.
    assert dict(got) == {(1, 0): 2, (1, 1): 1, (1, 2): 1, (2, 0): 1, (3, 0): 1, (9, 0): 1, (9, 1): 1}
    assert len(dict(got)) == len(got)


def test_live_upserts(spark, tmp_path):
    from pathloom.streaming.live import live_upserts, live_vectors

    path = str(tmp_path / "vec")
    step = live_upserts(path)
    make = lambda version, x: spark.createDataFrame([(1, [x], version)], "id long, vec array<double>, version long")
    step(make(1, 1.0), 0)
    step(make(2, 2.0), 1)
    step(make(1, 3.0), 3)  # a batch without rows need not have been written
    step(make(1, 3.0), 3)
    assert [tuple(r) for r in live_vectors(spark, path).collect()] == [(1, [2.0], 2)]
    step(make(2, 4.0), 4)
    assert live_vectors(spark, path).first()["vec"] == [4.0]


def test_keys_are_forgotten(spark, tmp_path):
    """A key that is silent for long leaves the state; when it comes again its numbers go on in the written table."""
    from pathloom.streaming.live import live_segments, numbered_segments

    now = 1_700_000_000
    times = [(1, 0), (1, 1000), (2, 1000), (9, 5000), (9, 9000), (9, 14000), (9, 20000), (1, 25000), (1, 25010), (9, 30000), (9, 40000), (9, 60000), (9, 80000)]
    df = spark.createDataFrame([(k, now + t, 0.0, float(k)) for k, t in times], "key long, t long, x double, y double").select("key", F.timestamp_seconds("t").alias("ts"), "x", "y")
    for i, t in enumerate(sorted({t // 1000 for _, t in times})):
        df.where(f"floor((unix_seconds(ts) - {now}) / 1000) = {t}").coalesce(1).write.parquet(str(tmp_path / f"in/{i:02d}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_segments(stream, 300.0, forget_seconds=2000.0).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    spark.table("forgotten").write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["seg"], r["n_points"]) for r in rows.where("key = 1").collect()) == [(0, 1), (0, 2), (1, 1)]
    again = numbered_segments(rows).where("key = 1").orderBy("start").collect()
    assert [(r["seg"], r["n_points"]) for r in again] == [(0, 1), (1, 1), (2, 2)]
    every = numbered_segments(rows)
    assert every.select("key", "seg").distinct().count() == every.count() == rows.count()
    # Keys 1 and 2 are gone, and 9 alone is held.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_compaction(spark, tmp_path):
    from pathloom.streaming.live import compact, live_upserts, live_vectors

    path = str(tmp_path / "vec")
    with pytest.raises(ValueError):
        live_vectors(spark, path)
    assert compact(spark, path) == -1
    step = live_upserts(path)
    for b in range(6):
        step(spark.createDataFrame([(b % 3, [float(b)], 1 + b // 4), (10 + b, [0.0], 1)], "id long, vec array<double>, version long"), b)
        before = sorted(map(tuple, live_vectors(spark, path).collect()))
        if b in (3, 5):
            assert compact(spark, path, keep=2) == b - 2
            assert compact(spark, path, keep=2) == b - 2
            assert sorted(map(tuple, live_vectors(spark, path).collect())) == before
            assert sorted(x.name for x in (tmp_path / "vec/batches").iterdir() if x.is_dir()) == [f"batch={b - 1}", f"batch={b}"]
            assert [x.name for x in (tmp_path / "vec/base").iterdir() if x.is_dir()] == [f"upto={b - 2}"]
    step(spark.createDataFrame([(0, [9.0], 2)], "id long, vec array<double>, version long"), 5)  # a kept batch may run again
    assert (0, [9.0], 2) in sorted(map(tuple, live_vectors(spark, path).collect()))


def _pairs(df):
    return {(r[0], r[1]): round(r[2], 9) for r in df.collect()}


def _gapped_points(spark):
    """Order points with copies under other ids, a point without x, one without keywords, and a null id."""
    p = order_points(spark, SF).where("tid < 60").select(*(c.split()[0] for c in POINTS.split(", ")))
    copy = p.where("tid % 3 = 1").withColumn("tid", F.col("tid") + 1000)
    odd = spark.createDataFrame([(20, 1, 0, None, 4.0, ["x"]), (20, 2, 0, 1.0, 4.0, []), (21, 1, 0, 1.0, None, ["x", "x", None]), (None, 1, 0, 1.0, 1.0, ["x"])], POINTS)
    return p.where("tid NOT IN (20, 21)").unionByName(copy).unionByName(odd)


def _few_rows_a_block(monkeypatch):
    monkeypatch.setattr(blocks, "PAIR_ROWS", 5)
    monkeypatch.setattr(blocks, "PAIR_ASKED", 4)
    monkeypatch.setattr(blocks, "PAIR_CONTENTS", 2)


def test_cell_distances_of_contents(spark, monkeypatch):
    """F8: blocks of different cell sets give the distances of the expression, over copies, gaps and borders of blocks."""
    _few_rows_a_block(monkeypatch)
    p = _gapped_points(spark)
    c = trajectory.summary(p, 25.0).select("tid", "cells")
    q = asked(c).select(F.col("tid").alias("qid"), F.col("cells").alias("q_cells"))
    want = _pairs(q.join(c, F.lit(True)).select("qid", "tid", simjoin.min_cell_distance(F.col("q_cells"), F.col("cells"))))
    got = _pairs(simjoin.cell_distances(asked(p), p, 25.0))
    assert got == want and len(want) > 200


def test_equal_contents_are_compared_once(spark):
    """F8: copies of a trajectory under other ids add rows, but no comparisons."""
    p = order_points(spark, SF).where("tid < 40").select("tid", F.array(F.col("pid").cast("double")).alias("c")).dropDuplicates(["tid"])
    copies = p.unionByName(p.withColumn("tid", F.col("tid") + 1000)).unionByName(p.withColumn("tid", F.col("tid") + 2000))
    compared = spark.sparkContext.accumulator(0)

    def make(block):
        def values(q):
            compared.add(len(block["c_n"]))
            return np.zeros(len(block["c_n"])), None

        return values

    counted = lambda rows: (blocks.every_value(asked(rows), rows, ("c",), make, "v").count(), compared.value)
    once = counted(p)
    thrice = counted(copies)
    assert thrice[0] == 9 * once[0]
    assert thrice[1] - once[1] < 3 * once[1]


def test_jaccards_of_contents(spark, monkeypatch):
    """as the expression, over copies, empty sets and borders of blocks."""
    _few_rows_a_block(monkeypatch)
    p = _gapped_points(spark)
    t = trajectory.summary(p, 25.0).select("tid", F.col("term_set").alias("terms"))
    q = asked(t).select(F.col("tid").alias("qid"), F.col("terms").alias("q_terms"))
    want = _pairs(q.join(t, F.lit(True)).select("qid", "tid", keywords.jaccard(F.col("q_terms"), F.col("terms"))))
    got = _pairs(simjoin.jaccards(asked(t), t))
    assert got == want and len(want) > 200


def test_pairs_come_in_small_batches(spark, monkeypatch):
    """however many copies two contents have, a batch of their pairs stays small."""
    monkeypatch.setattr(blocks, "PAIR_BATCH", 64)
    rows = spark.range(200).select(F.col("id").alias("tid"), F.array(F.lit(1.0)).alias("c"))
    v = blocks.every_value(asked(rows), rows, ("c",), lambda block: lambda q: (np.zeros(len(block["c_n"])), None), "v")
    assert v.count() == 10 * 200
    monkeypatch.setattr(blocks, "meet", lambda held, asked_, pairs, make, schema: make())
    begin, step = blocks.every_value(asked(rows), rows, ("c",), lambda block: lambda q: (np.zeros(1), None), "v")
    pack = lambda n: {"ids": np.arange(n).tobytes(), "of": np.zeros(n, "<i4").tobytes(), "c": np.ones(1).tobytes(), "c_n": np.ones(1, "<i4").tobytes()}
    made = [b.num_rows for b in step(begin(pack(50)), {f"q_{c}": v for c, v in pack(30).items()})]
    assert sum(made) == 1500 and max(made) <= 64 + 50


def test_candidate_bounds_of_contents(spark, monkeypatch):
    """as the join of candidate pairs gives them."""
    _few_rows_a_block(monkeypatch)
    p = _gapped_points(spark)
    want = _pairs(simjoin.trajectory_bounds(simjoin.candidates(asked(p), p), asked(p), p, 0.5, 0.01, 25.0))
    got = _pairs(simjoin.candidate_bounds(asked(p), p, 0.5, 0.01, 25.0))
    assert got == want and len(want) > 100


@pytest.mark.parametrize("points", [_gapped_points, lambda spark: line_points(spark, SF).where("tid < 300"), lambda spark: event_points(spark, SF).where("tid < 30")])
def test_candidate_similarities_of_contents(spark, monkeypatch, points):
    """F16: as the join of candidate pairs gives them."""
    _few_rows_a_block(monkeypatch)
    p = points(spark)
    want = _pairs(simjoin.verify(simjoin.candidates(asked(p), p), asked(p), p, 0.5, 0.01))
    got = _pairs(simjoin.candidate_similarities(asked(p), p, 0.5, 0.01))
    assert got == want and len(want) > 10


@pytest.mark.parametrize("name", ["box_pairs", "point_box_distance"])
def test_cross_joins_are_dealt_over_tasks(spark, name):
    """few bytes that make many rows aren't one task."""
    tasks = QUERIES[name](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > spark.sparkContext.defaultParallelism


def test_quick_rounding_is_sql_rounding(spark):
    """halves go away from zero; numbers that aren't finite, or large, stay as they were."""
    v = [0.0, 0.0078125, -0.0078125, 1.0000005, 2.5e-7, 5e-7, 123.4567891, 1e8 + 0.1234565, 1e12 + 0.25, 1e300, float("inf"), float("nan"), None, *np.random.default_rng(5).normal(0, 500, 300).tolist()]
    rows = spark.createDataFrame([(x,) for x in v], "x double")
    got = [r[0] for r in rows.select(fast6(F.col("x"))).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in v]
    assert [str(x) for x in got] == [str(x) for x in want]
    finite = np.array([x for x in v if x is not None and abs(x) < 1e9])
    assert blocks.rounded(finite, 6).tolist() == [x for x, y in zip(want, v, strict=True) if y is not None and abs(y) < 1e9]
