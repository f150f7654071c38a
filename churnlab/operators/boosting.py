"""Gradient-boosted trees on histograms, many models at once.

Features are cut into bins once.  A model grows its trees from sums of gradients per (node, feature, bin): second-order
gains and leaf weights with L1 and L2 terms, depth by depth, or best-first up to a number of leaves.  Best-first needs
no job per split: of the known nodes only those can be split that a search over the known ones alone would split, so
each pass asks for the children of all of these together.

Every model is a generator that asks for the sums of some nodes and gets each node's best split.  Two ways answer:

* the binned table is small (cells checked against ``SMALL_CELLS``): it is sent to the tasks, and Spark deals out the models;
* else rows stay where they are, and the sums of all live models come from one Spark aggregate per level.  The margins are
  rewritten to the checkpoint folder every few rounds.

Gradients are rounded to a grid so fine that their sums over all rows are exact (:func:`on_grid`).  So sums do not depend
on their order: both ways give the same trees (tested), a node's sums less one child's are the other child's, and
features may be summed together and taken apart again.  Random draws are hashes of (seed, row) or
(seed, round), independent of partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.session import cut_lineage

SMALL_CELLS = 128_000_000  # rows x features that are sent to every task (one byte each, some 6 with the work on them)
PACKS = (4096, 256)  # joint bins of features summed together: in nodes of many rows, and of few
BLOCK = 1 << 15  # rows summed at a time
TABLE_FEATURES = 8  # conditions up to which the shares of leaves are tabled for every pattern (bits of a byte)
CUT_ROUNDS = 10  # rounds between two rewrites of the margins


@dataclass(frozen=True)
class BoostParams:
    """``leaves``: best-first up to so many leaves (None: depth by depth); ``depth`` None: no limit."""
    rounds: int = 300
    rate: float = 0.05
    depth: int | None = 6
    leaves: int | None = None
    subsample: float = 1.0
    columns: float = 1.0
    min_weight: float = 1.0
    min_rows: int = 1
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    pos_weight: float = 1.0
    balanced: bool = False
    seed: int = 42


@dataclass
class Tree:
    """Nodes as parallel lists: feature -1 marks a leaf; ``left`` takes bins up to ``cut``.  ``cover``: sum of hessians."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> None:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for a, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.cover, 0.0)):
                a.append(v)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        f, c, lo, hi = (np.asarray(a) for a in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while True:
            go = f[at] >= 0
            if not go.any():
                return at
            n, r = at[go], rows[go]
            at[go] = np.where(bins[r, f[n]] <= c[n], lo[n], hi[n])

    def descend(self, cols: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, its rows) from columns of bins: a node's rows are parted, node by node."""
        todo = [(0, rows)]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                yield node, rows
            elif len(rows):
                goes = cols[self.feature[node]][rows] <= self.cut[node]
                todo += [(self.left[node], rows[goes]), (self.right[node], rows[~goes])]


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """U(0, 1) per 64-bit id and seed (a published 64-bit mixer)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def gradients(margin, y, weight):
    p = 1.0 / (1.0 + np.exp(-margin))
    return (p - y) * weight, np.maximum(p * (1.0 - p), 1e-16) * weight


def _grid(p: BoostParams, balance: tuple[float, float], n: int) -> float:
    """What :func:`on_grid` rounds with: the sum over ``n`` rows of the largest weight stays below 2^52 steps of the grid."""
    top = max(1.0, p.pos_weight) * (max(balance) if p.balanced else 1.0)
    return 3.0 * 2.0 ** (math.ceil(math.log2(max(1, n) * top)) - 1)


def on_grid(g: np.ndarray, h: np.ndarray, grid: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounded in place to multiples of grid / (3 * 2^51), hessians (a quarter at most) four times finer."""
    for v, c in ((g, grid), (h, grid / 4)):
        v += c
        v -= c
    return g, h


def pack(cols: np.ndarray, widths: list[int], most: int) -> list[tuple]:
    """Features summed together as (features, widths, joint bins, codes): at most ``most`` joint bins unless one has more."""
    groups: list[list[int]] = []
    for j in sorted(range(len(cols)), key=lambda j: -widths[j]):
        for g in groups:
            if math.prod(widths[k] for k in [*g, j]) <= most:
                g.append(j)
                break
        else:
            groups.append([j])
    out = []
    for g in groups:
        own = [widths[j] for j in g]
        codes = cols[g[0]]
        if len(g) > 1:
            codes = codes.astype(np.uint16 if math.prod(own) > 256 else np.uint8)
            for j, w in zip(g[1:], own[1:]):
                codes *= w
                codes += cols[j]
        out.append((g, own, math.prod(own), codes))
    return out


def node_sums(packs: list[list[tuple]], rows: list[np.ndarray], g: np.ndarray, h: np.ndarray, shape: tuple[int, int], used: np.ndarray, counted: bool) -> np.ndarray:
    """[2 or 3, nodes, features, bins] sums of g, h and (if asked for) rows over each node's rows.  Filled for the used
    features and the first one (it gives the totals)."""
    sizes = [len(r) for r in rows]
    rows, slot = np.concatenate(rows), np.repeat(np.arange(len(sizes)), sizes)
    kinds = 2 + counted
    chosen = min(packs, key=lambda ps: len(rows) * len(ps) + 2 * len(sizes) * sum(x[2] for x in ps))
    chosen = [x for x in chosen if 0 in x[0] or used[x[0]].any()]
    joint = [np.zeros((kinds, len(sizes), x[2])) for x in chosen]
    for lo in range(0, len(rows), BLOCK):
        at, own = rows[lo:lo + BLOCK], slot[lo:lo + BLOCK]
        first, last = int(own[0]), int(own[-1]) + 1
        weights = (g[at], h[at], None)[:kinds]
        own = own - first if last - first > 1 else None
        for (_, _, width, codes), j in zip(chosen, joint):
            code = codes[at].astype(np.intp)
            if own is not None:
                code += own * width
            for k, w in enumerate(weights):
                j[k, first:last] += np.bincount(code, w, (last - first) * width).reshape(-1, width)
    sums = np.zeros((kinds, len(sizes), *shape))
    for (features, widths, _, _), j in zip(chosen, joint):
        j = j.reshape(kinds, len(sizes), *widths)
        for i, (feature, w) in enumerate(zip(features, widths)):
            if used[feature] or feature == 0:
                sums[:, :, feature, :w] = j.sum(axis=tuple(k + 2 for k in range(len(widths)) if k != i))
    return sums


def level_sums(cols: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, n_bins: int, used: np.ndarray, counted: bool) -> np.ndarray:
    """[3, slots, features, bins] sums of g, h and rows over the rows of a slot (-1: of none), from columns of bins.

    A feature at a time: nothing of rows x features is made.  The first feature (it gives the totals) and the used ones
    are summed, rows are counted if asked for."""
    on = np.flatnonzero(slot >= 0)
    if len(on) < len(slot):
        slot, g, h = slot[on], g[on], h[on]
    base, size = slot * n_bins, slots * n_bins
    sums = np.zeros((3, slots, len(cols), n_bins))
    for j, col in enumerate(cols):
        if j and not used[j]:
            continue
        at = base + (col[on] if len(on) < len(col) else col)
        sums[0, :, j] = np.bincount(at, g, size).reshape(slots, n_bins)
        sums[1, :, j] = np.bincount(at, h, size).reshape(slots, n_bins)
        if counted:
            sums[2, :, j] = np.bincount(at, minlength=size).reshape(slots, n_bins)
    return sums


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) if alpha else g


def best_splits(sums: np.ndarray, p: BoostParams, used: np.ndarray) -> list[tuple]:
    """Per node (gain, feature, cut, G, H, rows, G, H, rows of the left side); gain 0: no split.  Ties: the first feature
    and bin.  ``sums`` without rows (a side of enough weight has some): they come back as infinite."""
    total = sums[:, :, 0, :].sum(axis=2)  # every feature has the same total
    left = np.cumsum(sums, axis=3)[..., :-1]
    right = total[:, :, None, None] - left

    def score(g, h):
        return _shrunk(g, p.alpha) ** 2 / (h + p.lam + 1e-12)

    gain = 0.5 * (score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1])[:, None, None]) - p.gamma
    ok = (left[1] >= p.min_weight) & (right[1] >= p.min_weight)
    if len(sums) > 2:
        ok &= (left[2] >= p.min_rows) & (right[2] >= p.min_rows)
    ok &= used[None, :, None]
    gain = np.where(ok, gain, 0.0).reshape(len(gain), -1)
    top = gain.argmax(axis=1)
    width = sums.shape[3] - 1
    out = []
    for s, t in enumerate(top):
        feature, cut = int(t // width), int(t % width)
        whole, side = ([float(v) for v in x] + [math.inf] * (3 - len(sums)) for x in (total[:, s], left[:, s, feature, cut]))
        out.append((float(gain[s, t]) if gain[s, t] > 1e-10 else 0.0, feature, cut, *whole, *side))
    return out


def _counted(p: BoostParams) -> bool:
    return p.min_rows > 1 or p.min_weight <= 0  # else a side of enough weight has a row


def grow(p: BoostParams):
    """Generator of one tree: yields (tree, nodes whose sums are wanted), is sent their best splits, returns the tree.
    Nodes that cannot be split (too deep, or too little for two sides) are not asked for: their parent's split has their sums."""
    tree, best, depth = Tree(), {}, {0: 0}

    def know(node: int, b: tuple) -> None:
        best[node] = b
        tree.cover[node] = b[4]
        tree.value[node] = -float(_shrunk(np.float64(b[3]), p.alpha)) / (b[4] + p.lam + 1e-12) * p.rate

    ask = [0]
    while ask:
        for node, b in zip(ask, (yield tree, ask)):
            know(node, b)
        can = [n for n, b in best.items() if b[0] > 0 and (p.depth is None or depth[n] < p.depth)]
        if p.leaves is not None:
            chosen = _best_first(tree, best, set(can), p.leaves)
            can = [n for n in can if n in chosen]
        ask = []
        for n in can:
            if tree.feature[n] < 0:
                tree.split(n, best[n][1], best[n][2])
                whole, side = best[n][3:6], best[n][6:9]
                for child, (g, h, rows) in ((tree.left[n], side), (tree.right[n], [a - b for a, b in zip(whole, side)])):
                    depth[child] = depth[n] + 1
                    if depth[child] == p.depth or h < 2 * p.min_weight or rows < 2 * p.min_rows:
                        know(child, (0.0, 0, 0, g, h))
                    else:
                        ask.append(child)
    if p.leaves is not None:  # splits that the growth of their betters has ruled out
        chosen = _best_first(tree, best, {n for n in best if tree.feature[n] >= 0}, p.leaves)
        for n in best:
            if tree.feature[n] >= 0 and n not in chosen:
                tree.feature[n] = -1
    return tree


def _best_first(tree: Tree, best: dict, can: set, leaves: int) -> set:
    """Nodes split by taking the leaf of largest gain again and again, among the nodes of ``can``."""
    import heapq

    queue, chosen = [(-best[0][0], 0)] if 0 in can else [], set()
    while queue and len(chosen) < leaves - 1:
        _, n = heapq.heappop(queue)
        chosen.add(n)
        if tree.feature[n] >= 0:
            for child in (tree.left[n], tree.right[n]):
                if child in can:
                    heapq.heappush(queue, (-best[child][0], child))
    return chosen


def _columns(p: BoostParams, r: int, n: int) -> np.ndarray:
    used = np.ones(n, dtype=bool)
    if p.columns < 1:
        keep = max(1, int(round(p.columns * n)))
        used[np.argsort(_uniform(np.arange(n), p.seed * 1_000_003 + r))[keep:]] = False
    return used


def _row_weights(p: BoostParams, y: np.ndarray, balance: tuple[float, float]) -> np.ndarray:
    w = np.where(y == 1, p.pos_weight, 1.0)
    return w * np.where(y == 1, balance[1], balance[0]) if p.balanced else w


def _kept_nodes(tree: Tree) -> np.ndarray:
    """Per node the leaf its rows end in: itself, or the node above whose split was taken back."""
    end = np.arange(len(tree.feature))
    for n in range(len(end)):  # children come after their parents
        if tree.left[n] and (tree.feature[n] < 0 or end[n] != n):
            end[[tree.left[n], tree.right[n]]] = end[n]
    return end


def train_local(bins: np.ndarray, n_bins: int, y: np.ndarray, ids: np.ndarray, train: np.ndarray, p: BoostParams, balance,
                rest_too: bool = True) -> tuple[list[Tree], np.ndarray]:
    """One model on a table in memory; (trees, margins of all rows).  Without ``rest_too`` the margins of rows that are
    not trained on are not kept.  A split parts its node's rows; only the smaller side is summed up."""
    n, f = bins.shape
    cols = np.ascontiguousarray(bins.T)
    packs = [pack(cols, [int(c.max(initial=0)) + 1 for c in cols], most) for most in PACKS]
    margin, trees, weight, grid = np.zeros(n), [], _row_weights(p, y, balance), _grid(p, balance, n)
    own = np.flatnonzero(train)
    away, own_ids, step = np.flatnonzero(~train) if rest_too else own[:0], ids[own] if p.subsample < 1 else None, np.zeros(n)
    for r in range(p.rounds):
        rows, rest = own, away
        if p.subsample < 1:
            keep = _uniform(own_ids, p.seed * 7919 + r) < p.subsample
            rows, rest = own[keep], np.concatenate([own[~keep], away])
        used = _columns(p, r, f)
        g, h = on_grid(*gradients(margin, y, weight), grid)
        at, sums = {0: rows}, {}  # rows of the nodes that were not parted, sums of those that may be
        growth = grow(p)
        tree, ask = next(growth)
        try:
            while True:
                _sum_asked(tree, ask, at, sums, cols, lambda some: node_sums(packs, some, g, h, (f, n_bins), used, _counted(p)))
                found = best_splits(np.stack([sums[c] for c in ask], axis=1), p, used)
                for c, b in zip(ask, found):
                    if b[0] <= 0:
                        del sums[c]
                tree, ask = growth.send(found)
        except StopIteration as done:
            tree = done.value
        value, end = np.asarray(tree.value), _kept_nodes(tree)
        for node, some in at.items():
            if tree.feature[node] < 0:
                step[some] = value[end[node]]
            else:  # its sides were not asked for
                step[some] = np.where(cols[tree.feature[node]][some] <= tree.cut[node], value[tree.left[node]], value[tree.right[node]])
        for leaf, some in tree.descend(cols, rest) if len(rest) else ():
            step[some] = value[leaf]
        margin += step  # rows not kept stay at 0
        trees.append(tree)
    return trees, margin


def _sum_asked(tree: Tree, ask: list[int], at: dict, sums: dict, cols: np.ndarray, summed) -> None:
    """Parts the rows of the asked nodes' parents and puts the asked nodes' sums into ``sums``: those of a parent's
    smaller side are summed up, the other side's are the rest."""
    if ask == [0]:
        sums[0] = summed([at[0]])[:, 0]
        return
    asked = set(ask)
    parents, small = [n for n in at if tree.left[n] in asked or tree.right[n] in asked], []
    for n in parents:
        rows, sides = at.pop(n), (tree.left[n], tree.right[n])
        goes = cols[tree.feature[n]][rows] <= tree.cut[n]
        at[sides[0]], at[sides[1]] = rows[goes], rows[~goes]
        small.append(min(sides, key=lambda c: len(at[c])))
    got = summed([at[c] for c in small])
    for i, (n, c) in enumerate(zip(parents, small)):
        own, whole = got[:, i], sums.pop(n)
        other = tree.left[n] + tree.right[n] - c
        if c in asked:
            sums[c] = own
        if other in asked:
            sums[other] = whole - own


class BoostedTrees:
    """Trees over ``edges`` (ascending cuts per feature); ``transform`` adds ``probability`` as Spark's classifiers do."""

    def __init__(self, edges: list[list[float]], trees: list[Tree]):
        self.edges, self.trees = edges, trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        cols, total, rows = np.ascontiguousarray(bin_rows(x, self.edges).T), np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            for leaf, some in t.descend(cols, rows):
                total[some] += t.value[leaf]
        return total

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def p(x: pd.Series) -> pd.Series:
            return pd.Series(1.0 / (1.0 + np.exp(-model.margins(np.stack(x.to_numpy()))))) if len(x) else pd.Series([], dtype=float)

        col = p(vector_to_array(F.col(features)))
        return df.withColumn("_p", col).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))).drop("_p")

    def shapley(self, x: np.ndarray, shares: list | None = None) -> tuple[np.ndarray, float]:
        """([rows, features], base): exact Shapley values of the margin; what a row does not tell is averaged by the
        nodes' covers.  A row's values and the base add up to its margin.  ``shares``: :func:`leaf_shares` of the trees."""
        bins = np.ascontiguousarray(bin_rows(x, self.edges).T)
        phi, got = np.zeros(bins.shape), np.empty(len(x))
        base, groups, leaves = shares or leaf_shares(self.trees)
        for conditions, feats, tables in groups:
            pattern = np.zeros(len(x), dtype=np.uint8)
            for i, (j, lo, span) in enumerate(conditions):
                pattern |= _holds(bins[j], lo, span).view(np.uint8) << np.uint8(i)
            at = pattern.astype(np.intp)
            for j, table in zip(feats, tables):
                phi[j] += table.take(at, out=got, mode="clip")  # a pattern is always inside; checked takes are buffered
        for conditions, value, share in leaves:
            follows = np.zeros(len(x), dtype=np.int64)
            for i, (j, lo, span) in enumerate(conditions):
                follows |= _holds(bins[j], lo, span).astype(np.int64) << i
            patterns, own = np.unique(follows, return_inverse=True)
            for (j, _, _), part in zip(conditions, _pattern_shares(value, share[None], patterns)):
                phi[j] += part[0][own]
        return phi.T, base

    def attributions(self, df: DataFrame, names: list[str], key: str = "customer_id", features: str = "features") -> DataFrame:
        """key, base, margin, attrib (array of feature and value): the model goes to the tasks, rows come in Arrow batches."""
        model = self
        rows = df.select(key, vector_to_array(F.col(features)).alias("x"))
        kind = rows.schema[key].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shares = None
            for f in frames:
                for lo in range(0, len(f), 8192):
                    part = f.iloc[lo:lo + 8192]
                    x = np.stack(part["x"].to_numpy())
                    shares = shares or leaf_shares(model.trees)  # once a task
                    phi, base = model.shapley(x, shares)
                    yield pd.DataFrame({key: part[key].to_numpy(), "base": base, "margin": model.margins(x), "phi": list(np.ascontiguousarray(phi))})

        got = rows.mapInPandas(run, f"`{key}` {kind}, base double, margin double, phi array<double>")
        pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("phi")[i].alias("value")) for i, n in enumerate(names)])
        return got.select(key, "base", "margin", pairs.alias("attrib"))


def _leaf_paths(tree: Tree) -> Iterator[tuple[float, dict]]:
    """(leaf value, {feature: (share of cover that follows the path, lowest bin, highest bin)}) per leaf."""
    todo = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = tree.feature[node]
        if f < 0:
            yield tree.value[node], path
            continue
        cover, cut = tree.cover[node] or 1.0, tree.cut[node]
        z, lo, hi = path.get(f, (1.0, 0, 255))
        left, right = tree.left[node], tree.right[node]
        todo.append((left, path | {f: (z * tree.cover[left] / cover, lo, min(hi, cut))}))
        todo.append((right, path | {f: (z * tree.cover[right] / cover, max(lo, cut + 1), hi)}))


def _holds(bins: np.ndarray, lo: np.uint8, span: np.uint8) -> np.ndarray:
    return bins <= span if not lo else (bins - lo) <= span  # bytes wrap around below the lowest bin


def _condition(feature: int, lo: int, hi: int) -> tuple[tuple, int]:
    """(feature, lowest bin, span) and 0, or that of the bins below and 1: a split's sides are one condition."""
    f, lo, hi, not_ = (feature, 0, lo - 1, 1) if hi == 255 and lo else (feature, lo, hi, 0)
    return (f, np.uint8(lo), np.uint8(hi - lo)), not_  # a split leaves rows on both sides: lo <= hi


def leaf_shares(trees: list[Tree]) -> tuple[float, list[tuple], list[tuple]]:
    """(base, groups of leaves as (conditions, features, shares), leaves as (conditions, value, shares of cover)).

    What a leaf adds to its path's features depends on which of its conditions a row follows.  Up to ``TABLE_FEATURES``
    conditions the shares are tabled for every such pattern, and neighbouring leaves that have no more conditions
    than that in all share one table; of a leaf with more the patterns that occur are worked out."""
    base, short, by_length, long = 0.0, [], {}, []
    for t in trees:
        for value, path in _leaf_paths(t):
            base += value * math.prod(z for z, _, _ in path.values())
            if not path or not value:
                continue
            if len(path) > TABLE_FEATURES:
                plain = [(f, np.uint8(lo), np.uint8(hi - lo)) for f, (_, lo, hi) in path.items()]
                long.append((plain, value, np.array([z for z, _, _ in path.values()])))
            else:
                by_length.setdefault(len(path), []).append(len(short))
                short.append((value, path))
    tables = [None] * len(short)
    for d, some in by_length.items():
        value, share = np.array([short[k][0] for k in some]), np.array([[z for z, _, _ in short[k][1].values()] for k in some])
        for k, table in zip(some, np.stack(_pattern_shares(value, share, np.arange(1 << d)), axis=1)):
            tables[k] = table
    groups, bits, members = [], {}, []

    def close() -> None:
        feats = sorted({f for own, _ in members for f, _, _ in own})
        patterns, joint = np.arange(1 << len(bits)), np.zeros((len(feats), 1 << len(bits)))
        for own, table in members:
            follows = sum((((patterns >> bits[c]) & 1) ^ not_) << i for i, (_, c, not_) in enumerate(own))
            for (f, _, _), part in zip(own, table):
                joint[feats.index(f)] += part[follows]
        groups.append((list(bits), feats, joint))

    for (_, path), table in zip(short, tables):
        own = [(f, *_condition(f, lo, hi)) for f, (_, lo, hi) in path.items()]
        if members and len(bits.keys() | {c for _, c, _ in own}) > TABLE_FEATURES:
            close()
            bits, members = {}, []
        for _, c, _ in own:
            bits.setdefault(c, len(bits))
        members.append((own, table))
    if members:
        close()
    return base, groups, long


def _pattern_shares(value, share: np.ndarray, patterns: np.ndarray) -> list[np.ndarray]:
    """Per path feature [leaves, patterns]: what a leaf adds to it if a row follows the conditions of the pattern's bits.
    Per feature left out, the others' product of (share missing + t if the row follows) is a polynomial whose
    coefficients sum the coalitions of each size."""
    d = share.shape[1]
    follows = [((patterns >> i) & 1).astype(float)[None, :] for i in range(d)]
    weight = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
    out, value = [], np.atleast_1d(value)[:, None]
    for i in range(d):
        poly = [np.ones((len(share), len(patterns)))]
        for o in range(d):
            if o != i:
                up = [c * follows[o] for c in poly]
                poly = [c * share[:, o, None] for c in poly] + [0.0]
                poly = [poly[0], *[a + b for a, b in zip(poly[1:], up)]]
        out.append(value * (follows[i] - share[:, i, None]) * sum(w * c for w, c in zip(weight, poly)))
    return out


def bin_rows(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def bin_edges(m: DataFrame, features: str = "features", bins: int = 64, error: float = 1e-3) -> list[list[float]]:
    """Ascending cuts per feature (at most bins - 1 each) from one pass of quantile sketches."""
    n = len(m.select(features).first()[0])
    cols = m.select(vector_to_array(features).alias("x")).select(*[F.col("x")[i].alias(f"x{i}") for i in range(n)])
    q = cols.approxQuantile(cols.columns, [k / bins for k in range(1, bins)], error)
    return [sorted(set(v)) for v in q]


def _table(m: DataFrame, edges, y: str, key: str, features: str) -> DataFrame:
    """id (64-bit hash of the key), y, fold, bins; cells are binned by binary search in the row's Arrow batch."""
    fold = F.col("fold") if "fold" in m.columns else F.lit(-1)
    rows = m.select(F.xxhash64(key).alias("id"), F.col(y).cast("double").alias("y"), fold.cast("int").alias("fold"), vector_to_array(features).alias("x"))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                bins = bin_rows(np.stack(f["x"].to_numpy()), edges)
                yield pd.DataFrame({"id": f["id"], "y": f["y"], "fold": f["fold"], "bins": [b.tobytes() for b in bins]})

    return rows.mapInPandas(cells, "id long, y double, fold int, bins binary")


def fit_many(m: DataFrame, jobs: list[tuple[BoostParams, int | None]], y: str = "churned", key: str = "customer_id", features: str = "features",
             edges: list[list[float]] | None = None, held_out: bool = False, small_cells: int = SMALL_CELLS):
    """Trains ``jobs`` = [(params, fold left out or None)] together.

    Returns ([BoostedTrees], None), or with ``held_out`` (None, DataFrame(job, y, p) of each job's left-out rows)."""
    edges = edges or bin_edges(m, features)
    n_bins = max(len(e) for e in edges) + 1
    table = cut_lineage(_table(m, edges, y, key, features))
    per = {(r["fold"], r["y"]): r["count"] for r in table.groupBy("fold", "y").count().collect()}  # folds x 2
    n = sum(per.values())
    balance = []
    for _, fold in jobs:
        c = [sum(v for (f, label), v in per.items() if label == k and f != fold) for k in (0.0, 1.0)]
        balance.append(tuple(sum(c) / (2.0 * max(1, x)) for x in c))
    train = _fit_small if n * len(edges) <= small_cells else _fit_large
    return train(table, jobs, balance, edges, n_bins, held_out, n)


def _arrays(frame: pd.DataFrame):
    """id, y, fold and the bin matrix of some rows."""
    bins = np.frombuffer(b"".join(frame["bins"]), dtype=np.uint8).reshape(len(frame), -1)
    return frame["id"].to_numpy(np.int64), frame["y"].to_numpy(float), frame["fold"].to_numpy(int), bins


def _fit_small(table: DataFrame, jobs, balance, edges, n_bins, held_out, n):
    """The table goes to the tasks (checked cells); one row a model is dealt out."""
    import pickle

    t = table.toArrow()  # at most SMALL_CELLS bytes of bins
    ids, y, fold = t["id"].to_numpy(), t["y"].to_numpy(), t["fold"].to_numpy().astype(np.int16)
    cols = np.empty((len(edges), n), np.uint8)
    lo = 0
    for c in (c for c in t["bins"].chunks if len(c)):
        start, end = np.frombuffer(c.buffers()[1], np.int32)[[c.offset, c.offset + len(c)]]
        cols[:, lo:lo + len(c)] = np.frombuffer(c.buffers()[2], np.uint8)[start:end].reshape(len(c), -1).T
        lo += len(c)
    del t
    spark = table.sparkSession
    order = sorted(range(len(jobs)), key=lambda j: -jobs[j][0].rounds * (jobs[j][0].depth or 8))  # long ones first
    models = spark.range(0, len(order), 1, len(order))  # one task a model

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for place in f["id"]:
                j = order[place]
                p, out = jobs[j]
                own = np.ones(n, bool) if out is None else fold != out
                trees, margin = train_local(cols.T, n_bins, y, ids, own, p, balance[j], rest_too=held_out)
                if held_out:
                    yield pd.DataFrame({"job": int(j), "y": y[~own].astype(int), "p": 1 / (1 + np.exp(-margin[~own]))})
                else:
                    yield pd.DataFrame({"job": [int(j)], "trees": [pickle.dumps(trees)]})

    if held_out:
        return None, cut_lineage(models.mapInPandas(run, "job int, y int, p double"))
    got = {r["job"]: pickle.loads(r["trees"]) for r in models.mapInPandas(run, "job int, trees binary").collect()}  # models, not rows
    return [BoostedTrees(edges, got[j]) for j in range(len(jobs))], None


def _fit_large(table: DataFrame, jobs, balance, edges, n_bins, held_out, n):
    """Rows stay where they are: one aggregate per level serves all live models."""
    f = len(edges)
    split = ["job", "slot", "gain", "feature", "cut", "g", "h", "n", "left_g", "left_h", "left_n"]
    state = cut_lineage(table.select("*", F.array_repeat(F.lit(0.0), len(jobs)).alias("margin")))
    done: list[list[Tree]] = [[] for _ in jobs]
    fresh: list[list[Tree]] = [[] for _ in jobs]  # not yet in ``margin``

    def margins(frame, bins, trees):
        m = np.stack(frame["margin"].to_numpy())
        for j, some in enumerate(trees):
            for t in some:
                m[:, j] += np.asarray(t.value)[t.place(bins)]
        return m

    for r in range(max(p.rounds for p, _ in jobs)):
        live = {j: grow(p) for j, (p, _) in enumerate(jobs) if r < p.rounds}
        wanted = {j: next(g) for j, g in live.items()}
        while wanted:
            trees, asks = [list(t) for t in fresh], dict(wanted)

            def sums(frames: Iterator[pd.DataFrame], trees=trees, asks=asks, r=r) -> Iterator[pd.DataFrame]:
                acc: dict[int, np.ndarray] = {}
                for frame in frames:
                    if not len(frame):
                        continue
                    ids, y, fold, bins = _arrays(frame)
                    m, cols = margins(frame, bins, trees), np.ascontiguousarray(bins.T)
                    for j, (tree, ask) in asks.items():
                        p, out = jobs[j]
                        slot_of = np.full(len(tree.feature), -1)
                        slot_of[ask] = np.arange(len(ask))
                        slot = slot_of[tree.place(bins)]
                        on = (slot >= 0) & (fold != (-2 if out is None else out))
                        if p.subsample < 1:
                            on &= _uniform(ids, p.seed * 7919 + r) < p.subsample
                        g, h = on_grid(*gradients(m[on, j], y[on], _row_weights(p, y[on], balance[j])), _grid(p, balance[j], n))
                        got = level_sums(cols[:, on], slot[on], g, h, len(ask), n_bins, _columns(p, r, f), True)
                        acc[j] = acc[j] + got if j in acc else got
                for j, got in acc.items():
                    for s in np.flatnonzero(got[2].any(axis=(1, 2))):
                        yield pd.DataFrame({"job": j, "slot": int(s), "feature": np.arange(f), "sums": list(np.swapaxes(got[:, s], 0, 1).reshape(f, -1))})

            used = {j: _columns(jobs[j][0], r, f) for j in asks}

            def choose(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
                j = int(keys[0])
                got = np.zeros((3, 1, f, n_bins))
                for feature, s in zip(frame["feature"], frame["sums"]):
                    got[:, 0, feature] += np.asarray(s).reshape(3, n_bins)
                return pd.DataFrame([(j, int(keys[1]), *best_splits(got, jobs[j][0], used[j])[0])], columns=split)

            k = 3 * n_bins
            part = state.mapInPandas(sums, "job int, slot int, feature int, sums array<double>")
            total = part.groupBy("job", "slot", "feature").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(k)]).alias("sums"))
            kinds = ["int", "int", "double", "int", "int", *["double"] * 6]
            rows = total.groupBy("job", "slot").applyInPandas(choose, ", ".join(f"{c} {t}" for c, t in zip(split, kinds))).collect()
            found = {(x["job"], x["slot"]): tuple(x)[2:] for x in rows}  # nodes of one level
            after = {}
            for j, (_, ask) in wanted.items():
                try:
                    after[j] = live[j].send([found.get((j, s), (0.0, 0, 0, *[0.0] * 6)) for s in range(len(ask))])
                except StopIteration as end:
                    done[j].append(end.value)
                    fresh[j].append(end.value)
            wanted = after
        if (r + 1) % CUT_ROUNDS == 0:
            trees = [list(t) for t in fresh]

            def advance(frames: Iterator[pd.DataFrame], trees=trees) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    if len(frame):
                        frame["margin"] = list(margins(frame, _arrays(frame)[3], trees))
                        yield frame

            state = cut_lineage(state.mapInPandas(advance, state.schema))
            fresh = [[] for _ in jobs]
    if not held_out:
        return [BoostedTrees(edges, t) for t in done], None
    trees = [list(t) for t in fresh]

    def left_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                _, y, fold, bins = _arrays(frame)
                m = margins(frame, bins, trees)
                for j, (_, out) in enumerate(jobs):
                    on = fold == out
                    yield pd.DataFrame({"job": j, "y": y[on].astype(int), "p": 1 / (1 + np.exp(-m[on, j]))})

    return None, cut_lineage(state.mapInPandas(left_out, "job int, y int, p double"))
