"""Gaussian neighbours of explained rows, drawn in tasks.

The draws are those of :func:`churnlab.operators.explain.hash_normal` over (seed, key, number, column).  As one column
expression they come to thousands of operations per neighbour, more than the JVM compiles as one method; here a task
draws a row's neighbours as vectors.  A score function that has ``arrays`` (vectors in, probabilities out) scores them
there, and only a row's sums leave the task (:func:`drawn_sums`, :func:`drawn_likeness`); for any other one neighbours
pass on to it as rows and are summed up in the same task.  They are neither written nor exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(seed: np.ndarray, data: list) -> np.ndarray:
    """XXH64 of the same-length strings ``data`` (a list of bytes, each a number or one per element of ``seed``), as
    Spark's ``xxhash64`` takes them: the hash of what came before is the seed."""
    data, size = [np.asarray(b, dtype=np.uint64) for b in data], len(data)

    def word(at: int, n: int):
        w = data[at]
        for i in range(1, n):
            w = w | (data[at + i] << np.uint64(8 * i))
        return w

    with np.errstate(over="ignore"):
        at = 0
        if size >= 32:
            v = [seed + P1 + P2, seed + P2, seed, seed - P1]
            while at + 32 <= size:
                v = [_turn(x + word(at + 8 * i, 8) * P2, 31) * P1 for i, x in enumerate(v)]
                at += 32
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ (_turn(x * P2, 31) * P1)) * P1 + P4
        else:
            h = seed + P5
        h = h + np.uint64(size)
        while at + 8 <= size:
            h = _turn(h ^ (_turn(word(at, 8) * P2, 31) * P1), 27) * P1 + P4
            at += 8
        if at + 4 <= size:
            h = _turn(h ^ (word(at, 4) * P1), 23) * P2 + P3
            at += 4
        for b in data[at:]:
            h = _turn(h ^ (b * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _fixed(data: bytes) -> tuple[np.ndarray, list[tuple]]:
    """XXH64 of a fixed string of less than 32 bytes as (what its seed is raised by, steps): a step is (word to
    combine with, bits to turn by, bits back, factor, summand or None)."""
    keep, steps, at = 2 ** 64 - 1, [], 0

    def word(n: int) -> int:
        return int.from_bytes(data[at:at + n], "little")

    while at + 8 <= len(data):
        w = word(8) * int(P2) & keep
        steps.append((((w << 31 | w >> 33) & keep) * int(P1) & keep, 27, P1, P4))
        at += 8
    if at + 4 <= len(data):
        steps.append((word(4) * int(P1) & keep, 23, P2, P3))
        at += 4
    steps += [(b * int(P5) & keep, 11, P1, None) for b in data[at:]]
    return _c(int(P5) + len(data)), [(_c(w), _c(r), _c(64 - r), _c(by), None if plus is None else _c(plus)) for w, r, by, plus in steps]


def _c(x) -> np.ndarray:
    return np.array(x, dtype=np.uint64)  # an array of one is taken faster than a number


_FINISH = [(_c(33), _c(P2)), (_c(29), _c(P3)), (_c(32), None)]
_ENDS = _fixed(b"a"), _fixed(b"b")
_S11 = _c(11)


def _rounds(h: np.ndarray, steps: list[tuple], t: np.ndarray, out: np.ndarray) -> None:
    """``out``: the hash after ``steps`` on the raised seeds ``h``; ``t`` is scratch."""
    for word, bits, back, by, plus in steps:
        np.bitwise_xor(h, word, out)
        h = out
        np.left_shift(h, bits, t)
        np.right_shift(h, back, h)
        np.bitwise_or(h, t, h)
        np.multiply(h, by, h)
        if plus is not None:
            np.add(h, plus, h)
    for bits, by in _FINISH:
        np.right_shift(h, bits, t)
        np.bitwise_xor(h, t, h)
        if by is not None:
            np.multiply(h, by, h)


def _uniform(h: np.ndarray, out: np.ndarray) -> None:
    """U(0, 1) of the high 53 bits."""
    np.right_shift(h, _S11, h)
    np.copyto(out, h.view(np.int64))
    np.add(out, 0.5, out)
    np.multiply(out, 1.0 / (1 << 53), out)


class Draws:
    """N(0, 1) of ``n`` neighbours per column: a row's seed fills [columns, n].  What no row changes, and the room
    to work in, is made once a task; every step is one pass over vectors that stay in the core's cache."""

    def __init__(self, cols: list[str], n: int):
        self.names = [c.encode() for c in cols]
        self.steps = [_fixed(c) if len(c) < 32 else None for c in self.names]
        self.numbers, self.room = np.empty(n, np.uint64), np.empty(n, np.uint64)
        self.own, self.end, self.t = (np.empty((len(cols), n), np.uint64) for _ in range(3))
        self.u = np.empty((len(cols), n))
        self.parts, lo = [], 0  # numbers of one length: where they stand, their raise and steps over all of them
        while lo < n:
            size = len(str(lo))
            text = [str(i).encode() for i in range(lo, min(n, 10 ** size))]
            each = [_fixed(t)[1] for t in text]
            steps = [(np.array([e[k][0] for e in each]), *each[0][k][1:]) for k in range(len(each[0]))]
            self.parts.append((slice(lo, lo + len(text)), _fixed(text[0])[0], steps))
            lo = 10 ** size

    def fill(self, seed: np.uint64, out: np.ndarray) -> None:
        """``out``: by Box-Muller on two hash uniforms."""
        with np.errstate(over="ignore"):
            for at, plus, steps in self.parts:
                _rounds(np.add(_c(seed), plus), steps, self.room[at], self.numbers[at])
            for name, steps, own in zip(self.names, self.steps, self.own, strict=True):
                if steps is None:
                    own[:] = xxh64(self.numbers, list(name))
                else:
                    np.add(self.numbers, steps[0], own)
                    _rounds(own, steps[1], self.room, own)
            np.add(self.own, _ENDS[0][0], self.own)
            _rounds(self.own, _ENDS[0][1], self.t, self.end)
            _uniform(self.end, out)
            np.log(out, out)
            np.multiply(out, -2.0, out)
            np.sqrt(out, out)
            _rounds(self.own, _ENDS[1][1], self.t, self.end)
            _uniform(self.end, self.u)
            np.multiply(self.u, 2.0 * np.pi, self.u)
            np.cos(self.u, self.u)
            np.multiply(out, self.u, out)


def _seeded(x: DataFrame, cols: list[str], seed: int, key: str, keep: list[str]) -> DataFrame:
    """key, the columns ``keep``, ``cols`` and the row's hash seed."""
    return x.select(key, *keep, *cols, F.xxhash64(F.lit(str(seed)), F.col(key).cast("string")).alias("_seed"))


def draw(x: DataFrame, cols: list[str], sd: dict, n: int, seed: int, key: str, keep: list[str]) -> DataFrame:
    """``n`` neighbours a row: key, the columns ``keep``, the moved ``cols`` and their draws ``_z_<col>``; a row's
    neighbours follow each other in its partition."""
    kinds, rows = dict(x.dtypes), _seeded(x, cols, seed, key, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(cols, n)
        for b in batches:
            seeds = b.column(b.num_columns - 1).to_numpy().view(np.uint64)
            at = [b.column(len(keep) + 1 + j).to_numpy() for j in range(len(cols))]
            for r in range(b.num_rows):
                z = np.empty((len(cols), n))
                draws.fill(seeds[r], z)
                same = [b.column(j).take(pa.array(np.full(n, r))) for j in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(v[r] + d * sd[c]) for v, d, c in zip(at, z, cols)), *map(pa.array, z)],
                                                 [key, *keep, *cols, *(f"_z_{c}" for c in cols)])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *keep)), *(f"`{c}` double" for c in cols), *(f"`_z_{c}` double" for c in cols)]))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows dealt out over the cores (few rows make much work); with ``key``, its rows side by side."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if key is None else df.repartition(n, key).sortWithinPartitions(key)


def key_runs(column: pa.Array) -> list[tuple[int, int]]:
    """(start, end) of the stretches of equal keys."""
    if not len(column):
        return []
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    cut = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    return list(zip(cut, cut[1:]))


def _sum_names(d: int) -> tuple[list[tuple[int, int]], list[str]]:
    pairs = [(a, b) for a in range(d + 1) for b in range(a, d + 1)]
    return pairs, [f"a_{a}_{b}" for a, b in pairs] + [f"b_{a}" for a in range(d + 1)]


def _sums(z: np.ndarray, p: np.ndarray, width: float, runs: list[tuple[int, int]]) -> np.ndarray:
    """The weighted sums of each stretch; the first row of ``z`` is ones."""
    w = np.exp(-(z[1:] ** 2).sum(axis=0) / (width * width))
    pairs, names = _sum_names(len(z) - 1)
    zw, out = z * w, np.empty((len(runs), len(names)))
    for r, (lo, hi) in enumerate(runs):  # vector by vector: no threads of a matrix product beside the tasks
        at = slice(lo, hi)
        out[r] = [*(zw[i, at] @ z[j, at] for i, j in pairs), *(row[at] @ p[at] for row in zw)]
    return out


def _per_key(part: DataFrame, key: str, names: list[str]) -> DataFrame:
    return part.groupBy(key).agg(*[F.sum(x).alias(x) for x in names])  # a few rows a key


def weighted_sums(scored: DataFrame, cols: list[str], key: str, width: float) -> DataFrame:
    """Per key the sums a_<i>_<j> and b_<i> of the weighted normal equations (weight exp(-|z|^2 / width^2))."""
    d = len(cols)
    names = _sum_names(d)[1]
    rows = scored.select(key, *[f"_z_{c}" for c in cols], "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = key_runs(batch.column(0))
            z = np.stack([np.ones(batch.num_rows), *(batch.column(1 + j).to_numpy() for j in range(d))])
            out = _sums(z, batch.column(d + 1).to_numpy(zero_copy_only=False), width, runs)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo for lo, _ in runs], pa.int64())), *(pa.array(out[:, j]) for j in range(len(names)))], [key, *names])

    return _per_key(rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, " + ", ".join(f"{x} double" for x in names)), key, names)


def _drawn(b: pa.RecordBatch, draws: Draws, z: np.ndarray, cols: list[str], keep: list[str], sd: dict, arrays) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of a batch of :func:`_seeded`: its place and its neighbours' probabilities; ``z`` is filled with their draws."""
    seeds = b.column(b.num_columns - 1).to_numpy().view(np.uint64)
    at = [b.column(len(keep) + 1 + j).to_numpy() for j in range(len(cols))]
    kept = [b.column(1 + j) for j in range(len(keep))]
    for r in range(b.num_rows):
        draws.fill(seeds[r], z)
        yield r, arrays({c: v[r].as_py() for c, v in zip(keep, kept)} | {c: v[r] + d * sd[c] for v, d, c in zip(at, z, cols)})


def drawn_sums(x: DataFrame, cols: list[str], sd: dict, n: int, seed: int, key: str, keep: list[str], arrays, width: float) -> DataFrame:
    """:func:`weighted_sums` of the neighbours of :func:`draw`, scored by ``arrays`` where they are drawn."""
    rows, d = _seeded(x, cols, seed, key, keep), len(cols)
    names = _sum_names(d)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, z = Draws(cols, n), np.ones((d + 1, n))
        for b in batches:
            if not b.num_rows:
                continue
            out = np.concatenate([_sums(z, p, width, [(0, n)]) for _, p in _drawn(b, draws, z[1:], cols, keep, sd, arrays)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, j]) for j in range(len(names)))], [key, *names])

    return _per_key(rows.mapInArrow(run, f"`{key}` {dict(x.dtypes)[key]}, " + ", ".join(f"{c} double" for c in names)), key, names)


def area(y: np.ndarray, s: np.ndarray) -> float | None:
    """AUC with ties counted half; None without both classes."""
    pos = int(y.sum())
    if pos in (0, len(y)):
        return None
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    neg = n - np.bincount(at, weights=y, minlength=len(n))
    return float(((n - neg) * (np.cumsum(neg) - neg / 2)).sum() / (pos * float(len(y) - pos)))


def likeness(scored: DataFrame, key: str) -> DataFrame:
    """key, _auc, _r2 of the columns p and s.  All rows of a key stand side by side in one partition."""
    rows = scored.select(key, "p", "s")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            p, s = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            yield b.column(0).type, [(b.column(0)[lo].as_py(), p[lo:hi], s[lo:hi]) for lo, hi in key_runs(b.column(0))]

    return _likeness(rows, pieces, key)


def drawn_likeness(x: DataFrame, cols: list[str], sd: dict, n: int, seed: int, key: str, keep: list[str], arrays) -> DataFrame:
    """:func:`likeness` of the neighbours of :func:`draw`, scored by ``arrays`` and by the row's own line (``intercept``,
    ``weights``) where they are drawn.  Rows of a key stand side by side in one partition."""
    kept = [*keep, "intercept", "weights"]
    rows = _seeded(x, cols, seed, key, kept)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        draws, z = Draws(cols, n), np.empty((len(cols), n))
        for b in batches:
            first, weights, found = b.column(1 + len(keep)), b.column(2 + len(keep)), []
            for r, p in _drawn(b, draws, z, cols, kept, sd, arrays):
                line = 0
                for w, own in zip(weights[r].as_py(), z):
                    line = line + w * own
                found.append((b.column(0)[r].as_py(), p, first[r].as_py() + line))
            yield b.column(0).type, found

    return _likeness(rows, pieces, key)


def _likeness(rows: DataFrame, pieces, key: str) -> DataFrame:
    """key, _auc, _r2 over the (key, p, s) of ``pieces``: those of one key follow each other, also from batch to batch."""

    def one(p: np.ndarray, s: np.ndarray):
        return area((p > 0.5).astype(float), s), float(1 - ((p - s) ** 2).sum() / (p.var() * len(p) + 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found):
            keys, got = [k for k, _ in found], [g for _, g in found]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([a for a, _ in got], pa.float64()), pa.array([r for _, r in got], pa.float64())],
                                              [key, "_auc", "_r2"])

        open_key, held, kind = None, [], None
        for kind, stretches in pieces(batches):
            found = []
            for k, p, s in stretches:
                if held and k != open_key:
                    found.append((open_key, one(*(np.concatenate(v) for v in zip(*held)))))
                    held = []
                open_key = k
                held.append((p, s))
            if found:
                yield made(found)
        if held:
            yield made([(open_key, one(*(np.concatenate(v) for v in zip(*held))))])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, _auc double, _r2 double")
