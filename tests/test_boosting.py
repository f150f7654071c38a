"""Histogram booster against a plain version, the two ways of training against each other, best-first growth."""

import heapq
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from churnlab.operators import models as MD
from churnlab.operators import boosting as BO
from churnlab.operators.boosting import BoostParams, bin_edges, bin_rows, fit_many, train_local
from churnlab.operators.metrics import auc_roc


def table(n=260, f=4, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, f)), 1)
    x[:, 3] = rng.integers(0, 2, n)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 3] + rng.normal(scale=0.7, size=n) > 0).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, int(t), i % 3, Vectors.dense(r)) for i, (r, t) in enumerate(zip(x.tolist(), y.tolist()))]
    return spark.createDataFrame(rows, ["customer_id", "churned", "fold", "features"])


def brute(bins, y, p, rounds):
    """Margins by loops over rows: second-order gains with L1, L2, gamma and minimum weight."""
    n, f = bins.shape
    margin = [0.0] * n

    def soft(g):
        return math.copysign(max(abs(g) - p.alpha, 0.0), g)

    def best(rows, g, h):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        top = (0.0, None, None)
        for j in range(f):
            for c in range(bins[:, j].max() + 1):
                left = [i for i in rows if bins[i, j] <= c]
                if len(left) < p.min_rows or len(rows) - len(left) < p.min_rows or not left or len(left) == len(rows):
                    continue
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl < p.min_weight or H - hl < p.min_weight:
                    continue
                gain = 0.5 * (soft(gl) ** 2 / (hl + p.lam) + soft(G - gl) ** 2 / (H - hl + p.lam) - soft(G) ** 2 / (H + p.lam)) - p.gamma
                if gain > top[0] + 1e-9:
                    top = (gain, j, c)
        return top, -soft(G) / (H + p.lam) * p.rate

    for _ in range(rounds):
        g = [(1 / (1 + math.exp(-m)) - t) * (p.pos_weight if t else 1) for m, t in zip(margin, y)]
        h = [1 / (1 + math.exp(-m)) * (1 - 1 / (1 + math.exp(-m))) * (p.pos_weight if t else 1) for m, t in zip(margin, y)]
        leaves = {0: (list(range(n)), 0)}
        split, value = best(leaves[0][0], g, h)
        queue, made, out = [(-split[0], 0, split, value)], 1, []
        while queue:
            gain, k, (_, j, c), value = heapq.heappop(queue)
            rows, depth = leaves[k]
            full = p.leaves is not None and len(queue) + len(out) + 1 >= p.leaves
            if j is None or full or (p.depth is not None and depth >= p.depth):
                out.append((rows, value))
                continue
            for part in ([i for i in rows if bins[i, j] <= c], [i for i in rows if bins[i, j] > c]):
                split, value = best(part, g, h)
                leaves[made] = (part, depth + 1)
                heapq.heappush(queue, (-split[0], made, split, value))
                made += 1
        for rows, value in out:
            for i in rows:
                margin[i] += value
    return np.array(margin)


@pytest.mark.parametrize("p", [BoostParams(depth=3, rate=0.3, lam=1.0, alpha=0.3, gamma=0.05, min_weight=2.0, pos_weight=1.7),
                               BoostParams(depth=None, leaves=7, rate=0.2, lam=0.1, min_weight=0.01, min_rows=5),
                               BoostParams(depth=4, leaves=6, rate=0.2, lam=0.5)])
def test_trees_equal_brute_force(p):
    x, y = table()
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0.1, 0.9, 9)).tolist())) for j in range(4)]
    bins = bin_rows(x, edges)
    from dataclasses import replace
    trees, margin = train_local(bins, 10, y, np.arange(len(y)), np.ones(len(y), bool), replace(p, rounds=4), (1.0, 1.0))
    assert np.allclose(margin, brute(bins, y.tolist(), p, 4), atol=1e-8)
    if p.leaves:
        assert all(len({*t.place(bins).tolist()}) <= p.leaves for t in trees)


def test_rows_in_place_give_the_same_models(spark):
    """The aggregate per level, with row and column samples, folds and several models, against the table sent to tasks."""
    x, y = table(150)
    m = frame(spark, x, y).repartition(3)
    jobs = [(BoostParams(rounds=3, depth=3, rate=0.3, subsample=0.8, columns=0.6, seed=5), 1), (BoostParams(rounds=2, depth=None, leaves=6, lam=0.0, min_rows=4, balanced=True), None)]
    edges = bin_edges(m, bins=12)
    small, large = (fit_many(m, jobs, edges=edges, small_cells=c)[0] for c in (10**9, 0))
    for a, b in zip(small, large, strict=True):
        assert np.allclose(a.margins(x), b.margins(x), atol=1e-9)
    sides = [fit_many(m, [(jobs[0][0], f) for f in range(3)], edges=edges, held_out=True, small_cells=c)[1] for c in (10**9, 0)]
    got = [sorted((r["job"], r["y"], round(r["p"], 9)) for r in s.collect()) for s in sides]
    assert got[0] == got[1] and len(got[0]) == len(y)


def test_presets_differ_and_learn(spark):
    x, y = table(900, seed=4)
    m = frame(spark, x, y)
    models = {n: MD.fit_boosted(m, n, rounds=30) for n in MD.BOOST_PRESETS}
    shapes = {n: max(len({*t.place(bin_rows(x, b.edges)).tolist()}) for t in b.trees) for n, b in models.items()}
    assert shapes["xgboost"] != shapes["lightgbm"] and shapes["lightgbm"] <= 63
    for b in models.values():
        s = b.transform(m)
        assert auc_roc(s.select("churned", MD.prob_of(s).alias("p")), "churned", "p").first()["auc_roc"] > 0.8


def test_tune_draws_all_ten_parameters(spark):
    x, y = table(120)
    m = frame(spark, x, y).drop("fold")
    drawn = MD.tune_trials("xgboost", 30)
    assert all(len(t) == 10 for t in drawn) and all(100 <= t["rounds"] <= 600 and 0.01 <= t["rate"] <= 0.3 for t in drawn)
    r = MD.tune(m, trials=2, k=2, timeout_s=None).collect()
    again = MD.tune(m.repartition(4), trials=2, k=2, timeout_s=None).collect()
    assert [x["cv_auc"] for x in r] == pytest.approx([x["cv_auc"] for x in again]) and sum(x["best"] for x in r) >= 1


def test_shapley_values_equal_all_subsets(spark):
    """Every subset of features: known ones follow the row, the others are averaged by cover."""
    from itertools import combinations

    x, y = table(120)
    m = frame(spark, x, y)
    model = fit_many(m, [(BoostParams(rounds=3, depth=4, rate=0.4, lam=0.5), None)], edges=bin_edges(m, bins=8))[0][0]
    bins = bin_rows(x, model.edges)

    def expected(t, row, known, node=0):
        f = t.feature[node]
        if f < 0:
            return t.value[node]
        a, b = t.left[node], t.right[node]
        if f in known:
            return expected(t, row, known, a if row[f] <= t.cut[node] else b)
        return (t.cover[a] * expected(t, row, known, a) + t.cover[b] * expected(t, row, known, b)) / t.cover[node]

    phi, base = model.shapley(x)
    assert np.allclose(phi.sum(axis=1) + base, model.margins(x))
    for r in range(0, len(x), 7):
        for j in range(4):
            want, rest = 0.0, [k for k in range(4) if k != j]
            for n in range(4):
                for s in combinations(rest, n):
                    w = math.factorial(n) * math.factorial(3 - n) / math.factorial(4)
                    want += w * sum(expected(t, bins[r], {*s, j}) - expected(t, bins[r], set(s)) for t in model.trees)
            assert phi[r, j] == pytest.approx(want, abs=1e-9)
    for r in model.attributions(m, list("abcd")).collect():
        assert sum(a["value"] for a in r["attrib"]) + r["base"] == pytest.approx(r["margin"])


def test_training_holds_no_row_per_cell():
    """Beside the table a few vectors of rows: nothing of 8 bytes per row and feature."""
    import tracemalloc

    rng = np.random.default_rng(2)
    n, f = 30_000, 24
    bins = rng.integers(0, 30, (n, f)).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 1] > rng.integers(0, 60, n)).astype(float)
    for p in (BoostParams(rounds=2, depth=4), BoostParams(rounds=2, depth=None, leaves=9, min_rows=5, subsample=0.7, columns=0.5)):
        tracemalloc.start()
        train_local(bins, 30, y, np.arange(n), np.arange(n) % 5 > 0, p, (1.0, 1.0))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * n * f, peak


@pytest.mark.parametrize("p", [BoostParams(rounds=4, depth=None, leaves=5, lam=0.1, min_rows=3, rate=0.3),
                               BoostParams(rounds=4, depth=3, min_weight=0.0, min_rows=1, subsample=0.6, columns=0.5, rate=0.3)])
def test_margins_are_the_trees_values(p):
    """Rows trained on, left out by the fold and left out by the sample, with splits that best-first took back."""
    x, y = table(400)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0.1, 0.9, 9)).tolist())) for j in range(4)]
    bins = bin_rows(x, edges)
    trees, margin = train_local(bins, 10, y, np.arange(400), np.arange(400) % 4 > 0, p, (1.0, 1.0))
    assert np.allclose(margin, sum(np.asarray(t.value)[t.place(bins)] for t in trees), atol=1e-12)


def test_leaf_tables_equal_patterns_worked_out(monkeypatch):
    """Shares tabled per leaf once (8,192 rows look them up) and worked out for the patterns that occur."""
    x, y = table(300)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0.1, 0.9, 9)).tolist())) for j in range(4)]
    trees, _ = train_local(bin_rows(x, edges), 10, y, np.arange(300), np.ones(300, bool), BoostParams(rounds=5, depth=5, rate=0.3), (1.0, 1.0))
    model = BO.BoostedTrees(edges, trees)
    phi, base = model.shapley(x)
    assert np.allclose(phi.sum(axis=1) + base, model.margins(x))
    monkeypatch.setattr(BO, "TABLE_FEATURES", 1)
    again, b = model.shapley(x)
    assert np.allclose(phi, again, atol=1e-12) and b == pytest.approx(base)


def test_presets_are_trained_side_by_side(spark, monkeypatch):
    """train_all hands both presets to one fit, as fit_boosted does: their tasks run at the same time."""
    from churnlab.plans import q_models as Q

    calls = []

    def short(m, jobs, *args, **given):
        calls.append(len(jobs))
        return fit_many(m, [(BoostParams(rounds=2, depth=2), f) for _, f in jobs], *args, **given)

    monkeypatch.setattr(MD, "fit_many", short)
    monkeypatch.setattr(MD, "fit_forest", lambda m: MD.fit_logreg(m, max_iter=2))
    Q.q_boosted(spark, "/root/testdata/sf0.001")
    Q.q_train_all(spark, "/root/testdata/sf0.001")
    assert calls == [2, 2]


@pytest.mark.parametrize("p", [BoostParams(rounds=3, depth=4, rate=0.3, subsample=0.8, columns=0.7, seed=3), BoostParams(rounds=3, depth=None, leaves=8, lam=0.0, min_weight=1e-3, min_rows=4, balanced=True, rate=0.3)])
def test_sums_are_exact_and_only_smaller_sides_are_summed(p, monkeypatch):
    """Rows in another order give the very same trees; below the root at most half of the rows of a level are read."""
    x, y = table(1500, seed=7)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0.05, 0.95, 19)).tolist())) for j in range(4)]
    bins, ids, read, summed = bin_rows(x, edges), np.arange(1500), [], BO.node_sums

    def spy(packs, rows, *rest):
        read.append(sum(len(r) for r in rows))
        return summed(packs, rows, *rest)

    monkeypatch.setattr(BO, "node_sums", spy)
    trees, margin = train_local(bins, 20, y, ids, np.ones(1500, bool), p, (0.9, 1.2))
    assert read[0] > 750 and sorted(read)[-4] <= read[0] / 2 + 100 and max(read[1:3]) <= 750
    order = np.random.default_rng(0).permutation(1500)
    again, m = train_local(bins[order], 20, y[order], ids[order], np.ones(1500, bool), p, (0.9, 1.2))
    assert trees == again and (margin[order] == m).all()


def test_packed_sums_equal_plain_ones(monkeypatch):
    """Joint bins of several features, blocks that part nodes, a node without rows."""
    rng = np.random.default_rng(4)
    cols = np.stack([rng.integers(0, w, 5000) for w in (30, 2, 1, 12, 3, 64)]).astype(np.uint8)
    g, h = BO.on_grid(rng.normal(size=5000) / 4, rng.random(5000) / 4, BO._grid(BoostParams(), (1.0, 1.0), 5000))
    slot = rng.choice([0, 1, 3], 5000)
    rows = [np.flatnonzero(slot == k) for k in range(4)]
    used = np.array([False, True, True, True, False, True])
    want = BO.level_sums(cols, slot, g, h, 4, 64, used, True)
    monkeypatch.setattr(BO, "BLOCK", 700)
    for most in (4096, 100, 1):
        packs = [BO.pack(cols, [30, 2, 1, 12, 3, 64], most)]
        assert sorted(j for x in packs[0] for j in x[0]) == list(range(6))
        assert (BO.node_sums(packs, rows, g, h, (6, 64), used, True) == want).all()
        assert (BO.node_sums(packs, rows, g, h, (6, 64), used, False) == want[:2]).all()


def test_neighbouring_leaves_share_a_table():
    """Far fewer tables than leaves, none of more patterns than a byte has; values as worked out leaf by leaf."""
    x, y = table(2000, seed=9)
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0.05, 0.95, 19)).tolist())) for j in range(4)]
    trees, _ = train_local(bin_rows(x, edges), 20, y, np.arange(2000), np.ones(2000, bool), BoostParams(rounds=6, depth=6, rate=0.3), (1.0, 1.0))
    base, groups, long = BO.leaf_shares(trees)
    leaves = [x for t in trees for x in BO._leaf_paths(t)]
    assert not long and 2 * len(groups) < len(leaves) and all(t.shape == (len(feats), 2 ** len(c)) and len(c) <= 8 for c, feats, t in groups)
    bins, phi = bin_rows(x[:200], edges), np.zeros((200, 4))
    for value, path in leaves:
        follows = sum(((bins[:, f] >= lo) & (bins[:, f] <= hi)).astype(int) << i for i, (f, (_, lo, hi)) in enumerate(path.items()))
        shares = BO._pattern_shares(value, np.array([[z for z, _, _ in path.values()]]), follows)
        for f, s in zip(path, shares):
            phi[:, f] += s[0]
    got, b = BO.BoostedTrees(edges, trees).shapley(x[:200])
    assert np.allclose(got, phi, atol=1e-12) and b == base


def test_six_gigabytes_of_customers_go_to_the_tasks():
    """4,319,712 rows of 27 features: no job per tree level; a task holds some vectors of rows beside the table."""
    assert 4_319_712 * 27 <= BO.SMALL_CELLS
    import tracemalloc

    rng = np.random.default_rng(5)
    cols = rng.integers(0, 30, (27, 200_000)).astype(np.uint8)
    y = (cols[0] + cols[1] > rng.integers(0, 60, 200_000)).astype(float)
    for p in (BoostParams(rounds=2, depth=6), BoostParams(rounds=2, depth=None, leaves=63, lam=0.0, min_weight=1e-3, min_rows=20)):
        tracemalloc.start()
        train_local(cols.T, 30, y, np.arange(200_000), np.ones(200_000, bool), p, (1.0, 1.0), rest_too=False)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * cols.size, peak / cols.size
