"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another.  The model of a category sees the text's features and the probabilities
of the categories before it.  In training those probabilities are out-of-fold: they come from models that did not see
the row, so later models learn how far earlier ones can be trusted.

Features are binary: words, word starts of 4 letters (which catch compounds) and coarse shape bins.  Their counts are
taken over the labelled sample.  Kept are those whose share of a category's positives differs from the sample's by more
evidence (rows times Kullback-Leibler divergence) than chance gives among so many features, the strongest first.
The sample is bounded by ``max_labelled`` rows, the least by a hash of the id; the fit is one task over it.  Scoring
covers every row and whole texts, without a shuffle.

Rows: null or empty texts have no word features and get the probability of none; repeated rows repeat their result;
labels that repeat an id count once (positive if any is); null labels are no labels.  A category without both classes
gets its smoothed share as a constant.  Empty labels give 0.5, and nothing is rejected.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, hash128, texts_of

_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    words = _WORDS.findall(text.lower())
    own = set(words)
    # a long word is named by its start and a digest of the whole: memory stays bounded, no word is left out
    out = {"w:" + (w if len(w) < 40 else w[:8] + hashlib.sha256(w.encode()).hexdigest()[:24]) for w in own}
    out.update({"p:" + w[:4] for w in own if len(w) > 4})
    out.update(shape(text, len(words), len(own)))
    return out


def shape(text: str, n_words: int, n_distinct: int) -> set[str]:
    n = max(1, len(text))
    marks = sum(map(text.count, "!%$&*|#@"))
    upper = sum(map(str.isupper, text)) / n
    return {f"s:len{min(12, int(np.log2(n_words + 1)))}", f"s:marks{min(9, int(50 * marks / n))}", f"s:upper{int(5 * upper)}",
            f"s:distinct{int(6 * n_distinct / max(1, n_words))}"}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, steps: int = 12, inner: int = 30):
    """Logistic regression over binary sparse features and dense columns by Newton steps, each solved by conjugate
    gradients.  Returns (weights, dense weights, bias); the bias is not shrunk."""
    n, d = dense.shape
    penalty = np.concatenate([np.full(k + d, ridge), [1e-6]])

    def forward(t):
        return np.bincount(rows, weights=t[cols], minlength=n) + dense @ t[k:k + d] + t[-1]

    def back(u):
        return np.concatenate([np.bincount(cols, weights=u[rows], minlength=k), dense.T @ u, [u.sum()]])

    def loss(t, m):
        return np.logaddexp(0, m).sum() - (y * m).sum() + (penalty * t * t).sum() / 2

    theta = np.zeros(k + d + 1)
    theta[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    margin = forward(theta)
    for _ in range(steps):
        p = _sigmoid(margin)
        grad, curve = back(p - y) + penalty * theta, np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(theta), -grad
        q, rr = r.copy(), r @ r
        stop = 1e-6 * rr
        for _ in range(inner):
            if rr <= stop:
                break
            hq = back(curve * forward(q)) + penalty * q
            alpha = rr / (q @ hq)
            step += alpha * q
            r -= alpha * hq
            rr, old = r @ r, rr
            q = r + rr / old * q
        size, now, moved = 1.0, loss(theta, margin), forward(step)
        while size > 1e-3 and loss(theta + size * step, margin + size * moved) > now:
            size /= 2
        theta, margin = theta + size * step, margin + size * moved
        if np.abs(size * step).max() < 1e-4:
            break
    return theta[:k], theta[k:k + d], float(theta[-1])


def predict_linear(model, rows, cols, dense):
    w, v, b = model
    return _sigmoid(np.bincount(rows, weights=w[cols], minlength=len(dense)) + dense @ v + b)


def fit_chain(ids: list[list[int]], labels: np.ndarray, fold: np.ndarray, k: int, n_folds: int) -> dict:
    """Chain over the label columns in order; nan: no label."""
    n = len(ids)
    rows = np.repeat(np.arange(n), [len(x) for x in ids])
    cols = np.fromiter((c for x in ids for c in x), dtype=np.int64, count=len(rows))
    earlier, models, held_out = np.zeros((n, 0)), [], []
    for j in range(labels.shape[1]):
        known = ~np.isnan(labels[:, j])
        y = np.nan_to_num(labels[:, j])

        def fit(use):
            at = np.flatnonzero(use)
            pos = np.full(n, -1)
            pos[at] = np.arange(len(at))
            keep = use[rows]
            return fit_linear(pos[rows[keep]], cols[keep], earlier[at], y[at], k)

        if not known.any() or len(set(y[known].tolist())) < 2:
            share = (y[known].sum() + 1) / (known.sum() + 2)
            models.append((np.zeros(k), np.zeros(earlier.shape[1]), float(np.log(share / (1 - share)))))
            oof = np.full(n, share)
        else:
            oof = np.zeros(n)
            for f in range(n_folds):
                use = known & (fold != f)
                model = fit(use if len(set(y[use].tolist())) == 2 else known)
                oof[fold == f] = predict_linear(model, rows, cols, earlier)[fold == f]
            models.append(fit(known))
        held_out.append(oof)
        earlier = np.column_stack([earlier, oof])
    last = labels.shape[1] - 1
    return {"models": [(np.round(w, 6).tolist(), v.tolist(), b) for w, v, b in models], "threshold": _threshold(held_out[-1], labels[:, last])}


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The out-of-fold probability with the best F1, in the middle of the gap it stands in; 0.5 without both classes."""
    p, y = p[~np.isnan(y)], y[~np.isnan(y)]
    if len(p) == 0 or y.min() == y.max():
        return 1.1 if len(p) == 0 else 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    """The batches in pieces: a text's features as Python strings take many times its bytes, those of a whole batch too much."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], max_labelled: int = 20_000, n_features: int = 1_000,
                min_rows: int = 4, n_folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """labels(doc_id, one 0/1 column per category) -> the chain: vocabulary, models, threshold of the last category."""
    lab = labels.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("double").alias(f"y{j}") for j, c in enumerate(categories)])
    ys = [f"y{j}" for j in range(len(categories))]
    lab = lab.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys]).filter(F.coalesce(*ys).isNotNull())
    sample = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = texts_of(docs, id_col, text_col)
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", *ys, "text")  # at most max_labelled rows on the broadcast side

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            feats = [sorted(features(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(feats, pa.list_(pa.string()))], [*b.schema.names[:-1], "f"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    table = cut_lineage(rows.mapInArrow(extract, f"doc_id {kind}, {', '.join(f'{y} double' for y in ys)}, f array<string>"))
    share = table.agg(F.count(F.lit(1)), *[F.avg(y) for y in ys]).first()
    counts = table.select(*ys, F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(y, F.lit(0.0))).alias(y) for y in ys])
    counts = cut_lineage(counts.filter(F.col("n") >= min_rows))
    least = float(np.log(max(1, counts.count()))) + 2  # evidence that chance hardly gives any of so many features
    vocabulary: list[str] = []
    for j, y in enumerate(ys):  # n_features strings per category at most
        p = share[1 + j]
        if p is None or not 0 < p < 1:
            continue
        q, zero = F.col(y) / F.col("n"), F.lit(0.0)
        evidence = F.col("n") * (F.when(q > 0, q * F.log(q / p)).otherwise(zero) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(zero))
        told = counts.select("f", evidence.alias("e")).filter(F.col("e") >= least)
        vocabulary += [r["f"] for r in told.orderBy(F.col("e").desc(), "f").limit(n_features).select("f").collect()]
    vocabulary = sorted(set(vocabulary))
    if not vocabulary and not share[0]:
        return {"categories": categories, "vocabulary": [], "models": [([], [0.0] * j, 0.0) for j in range(len(ys))], "threshold": 1.1}
    index = {f: i for i, f in enumerate(vocabulary)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids = [[index[f] for f in x if f in index] for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int64()))], [*b.schema.names[:-1], "ids"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fold_key", kind="stable").reset_index(drop=True)
        chain = fit_chain([list(x) for x in pdf["ids"]], pdf[ys].to_numpy(dtype=float), (pdf["fold_key"] % n_folds).to_numpy(), len(vocabulary), n_folds)
        return pd.DataFrame({"model": [json.dumps(chain)]})

    picked = table.mapInArrow(pick, f"doc_id {kind}, {', '.join(f'{y} double' for y in ys)}, ids array<long>")
    keyed = picked.select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)).alias("fold_key"), *ys, "ids", F.lit(0).alias("one"))
    model = keyed.groupBy("one").applyInPandas(fit, "model string").first()  # the bounded sample, one task
    return {"categories": categories, "vocabulary": vocabulary} | json.loads(model["model"])


def score_chain(docs: DataFrame, chain: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, rejected, for every row."""
    texts = texts_of(docs, id_col, text_col)
    names = [f"p_{c}" for c in chain["categories"]]
    vocabulary, models, threshold = chain["vocabulary"], chain["models"], chain["threshold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {f: i for i, f in enumerate(vocabulary)}
        whole = {f[2:] for f in vocabulary if f.startswith("w:")}
        start = {f[2:] for f in vocabulary if f.startswith("p:")}
        weights = [(np.array(w), v, b) for w, v, b in models]
        for batch in pieces(batches):
            out = [[] for _ in weights]
            for text in batch.column(1).to_pylist():
                words = _WORDS.findall(text.lower())
                own = set(words)
                at = [index["w:" + f] for f in whole & own] + [index["p:" + f] for f in start & {w[:4] for w in own if len(w) > 4}]
                at += [index[f] for f in shape(text, len(words), len(own)) if f in index]
                seen: list[float] = []
                for (w, v, b), o in zip(weights, out, strict=True):
                    p = float(_sigmoid(w[at].sum() + sum(x * y for x, y in zip(v, seen, strict=True)) + b)) if len(w) else float(_sigmoid(b))
                    seen.append(p)
                    o.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.float64()) for o in out),
                                              pa.array([p >= threshold for p in out[-1]], pa.bool_())], ["doc_id", *names, "rejected"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, {', '.join(f'`{x}` double' for x in names)}, rejected boolean")


def toxicity_labels(labels: DataFrame) -> DataFrame:
    """The chain's categories from the labels table: low quality first, toxic last."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` (all columns) that the chain does not reject."""
    chain = train_chain(docs, toxicity_labels(labels), ["low_quality", "toxic"], id_col=id_col, text_col=text_col, **params)
    gone, a, t = score_rejected(docs, chain, text_col), fresh(docs, "_t1"), fresh(docs, "_t2")
    t1, t2 = hash128(F.coalesce(docs[text_col], F.lit("")))
    gone = gone.select(F.col("t1").alias(a), F.col("t2").alias(t))
    return docs.join(gone, (t1 == gone[a]) & (t2 == gone[t]), "left_anti")


def score_rejected(docs: DataFrame, chain: dict, text_col: str = "text") -> DataFrame:
    """t1, t2: hashes of the texts that the chain rejects, once each."""
    t1, t2 = hash128(F.col("text"))
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = own.select(F.struct(t1.alias("t1"), t2.alias("t2")).alias("key"), "text")
    return score_chain(keyed, chain, "key").filter("rejected").select("doc_id.t1", "doc_id.t2").distinct()
