"""Model fit, scoring and selection on Spark ML; a deterministic scorecard as a pluggable ``score_fn``.

``score_fn`` everywhere is ``DataFrame -> DataFrame`` adding a probability
column ``p``: a fitted Spark ML pipeline (:func:`ml_score_fn`) or the
:class:`Scorecard` plug in the same way.
"""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators.boosting import BoostParams, bin_edges, fit_many
from churnlab.operators.metrics import auc_roc
from churnlab.operators.prep import class_weights, prep_pipeline, stratified_folds
from churnlab.session import cut_lineage

# Churn logit of the synthetic customer generator (weights on min-max normalised inputs).
CONTRACT_RISK = {"Month-to-Month": 1.0, "One Year": 0.4, "Two Year": 0.1}
LOGIT_WEIGHTS = [
    ("num_support_tickets_30d", 1.5),
    ("feature_adoption_rate", -1.5),
    ("login_frequency_30d", -1.2),
    ("days_since_last_login", 1.8),
    ("nps_score", -1.0),
    ("tenure_months", -0.8),
]
CONTRACT_WEIGHT = 2.5
DECLINE_WEIGHT = 1.0
DECLINE_AT = 0.2  # our choice: usage decline rate that marks a declining customer


class Scorecard:
    """Logistic scorecard: sigmoid(intercept + weights . minmax(x)); null inputs contribute 0.

    ``fit`` takes min / max per input and sets the intercept so the mean logit
    matches the target churn rate (two one-row aggregates).
    """

    def __init__(self, mins: dict, maxs: dict, intercept: float):
        self.mins, self.maxs, self.intercept = mins, maxs, intercept

    @staticmethod
    def _raw(df_cols_min, df_cols_max) -> Column:
        z = F.lit(CONTRACT_WEIGHT) * F.coalesce(
            F.when(F.col("contract_type") == "Month-to-Month", 1.0).when(F.col("contract_type") == "One Year", 0.4)
            .when(F.col("contract_type") == "Two Year", 0.1), F.lit(0.0))
        for c, w in LOGIT_WEIGHTS:
            n = (F.col(c) - F.lit(df_cols_min[c])) / (F.lit(df_cols_max[c] - df_cols_min[c]) + F.lit(1e-9))
            z = z + F.lit(w) * F.coalesce(n, F.lit(0.0))
        dec = F.coalesce((fx.usage_decline() >= DECLINE_AT).cast("double"), F.lit(0.0))
        return z + F.lit(DECLINE_WEIGHT) * dec

    @classmethod
    def fit(cls, df: DataFrame, churn_rate: float = 0.27) -> "Scorecard":
        cols = [c for c, _ in LOGIT_WEIGHTS]
        r = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
        mins = {c: float(r[f"mn_{c}"] or 0.0) for c in cols}
        maxs = {c: float(r[f"mx_{c}"] or 0.0) for c in cols}
        mean = df.agg(F.avg(cls._raw(mins, maxs)).alias("m")).first()["m"] or 0.0
        return cls(mins, maxs, math.log(churn_rate / (1 - churn_rate)) - float(mean))

    def logit(self) -> Column:
        return self._raw(self.mins, self.maxs) + F.lit(self.intercept)

    def __call__(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit())))

    def arrays(self, v: dict) -> np.ndarray:
        """``p`` of :meth:`__call__` from a vector, or one value or None for all, per input column."""
        z = CONTRACT_WEIGHT * CONTRACT_RISK.get(v["contract_type"], 0.0)
        for c, w in LOGIT_WEIGHTS:
            if v[c] is not None:
                z = z + w * ((v[c] - self.mins[c]) / (self.maxs[c] - self.mins[c] + 1e-9))
        u30, u90 = v["usage_30d"], v["usage_90d"]
        if u30 is not None and u90 is not None:
            decline = np.fmin(np.maximum((u90 - u30) / np.maximum(u90, 1e-6), -2.0), 2.0)  # NaN is above all, as in Spark
            z = z + DECLINE_WEIGHT * (decline >= DECLINE_AT)
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(z + self.intercept)))


# ---------------------------------------------------------------------------------------------
# Spark ML
# ---------------------------------------------------------------------------------------------
# Boosted-tree presets (rounds, learning rate, depth or leaves, class weights, regularisation).
BOOST_PRESETS = {
    "xgboost": BoostParams(rounds=300, rate=0.05, depth=6, pos_weight=2.7, lam=1.0, min_weight=1.0),
    "lightgbm": BoostParams(rounds=300, rate=0.05, depth=None, leaves=63, balanced=True, lam=0.0, min_weight=1e-3, min_rows=20),
}


def training_width(df: DataFrame) -> int:
    """Partitions for iterative training: one per core of the cluster (each optimizer step is a job)."""
    try:
        return max(1, df.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - sessions without a driver-side context
        return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def prepare(train: DataFrame, y: str = "churned"):
    """Fit the preparation pipeline on the training rows; returns (fitted pipeline, weighted train matrix).
    The matrix is narrowed (no shuffle) to the cluster's core count: iterative fits run one job per
    step, and hundreds of tiny post-shuffle partitions would make every step schedule hundreds of tasks."""
    prep = prep_pipeline().fit(train)
    m = class_weights(prep.transform(train), y)
    n = training_width(m)
    if m.rdd.getNumPartitions() > n:
        m = m.coalesce(n)
    return prep, m


def fit_logreg(m: DataFrame, y: str = "churned", max_iter: int = 1000):
    return LogisticRegression(featuresCol="features", labelCol=y, weightCol="weight", maxIter=max_iter).fit(m)


def fit_forest(m: DataFrame, y: str = "churned", trees: int = 300, seed: int = 42):
    return RandomForestClassifier(featuresCol="features", labelCol=y, weightCol="weight", numTrees=trees, seed=seed).fit(m)


def boost_params(preset: str, seed: int = 42, rounds: int | None = None) -> BoostParams:
    p = BOOST_PRESETS[preset]
    return replace(p, seed=seed, rounds=rounds or p.rounds)


def fit_boosted(m: DataFrame, preset: str = "xgboost", y: str = "churned", seed: int = 42, rounds: int | None = None, key: str = "customer_id"):
    """Depth by depth with a positive weight ("xgboost"), or best-first to 63 leaves with balanced weights ("lightgbm")."""
    return fit_boosted_many(m, [preset], y, seed, rounds, key)[preset]


def fit_boosted_many(m: DataFrame, presets, y: str = "churned", seed: int = 42, rounds: int | None = None, key: str = "customer_id") -> dict:
    """{preset: model}: the presets are trained side by side on one binned table."""
    return dict(zip(presets, fit_many(m, [(boost_params(n, seed, rounds), None) for n in presets], y, key)[0]))


def prob_of(df: DataFrame, col: str = "probability") -> Column:
    return vector_to_array(F.col(col))[1]


def ml_score_fn(prep, model, out: str = "p"):
    """Wrap a fitted preparation pipeline + classifier as ``score_fn``."""
    def fn(df: DataFrame) -> DataFrame:
        # the preparation caps, fills and scales columns in place: the row is kept beside it as it came
        t = model.transform(prep.transform(df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]))))
        return t.select("_row.*", prob_of(t).alias(out))
    return fn


def save_fitted(prep, model, path: str) -> str:
    """Writes a fitted preparation and classifier as one pipeline (Spark's own writer, any Hadoop file system)."""
    from pyspark.ml import PipelineModel

    PipelineModel([*prep.stages, model]).write().overwrite().save(path)
    return path


def load_fitted(path: str):
    """(preparation, classifier) of :func:`save_fitted`."""
    from pyspark.ml import PipelineModel

    stages = PipelineModel.load(path).stages
    return PipelineModel(stages[:-1]), stages[-1]


def logistic_terms(prep, model) -> tuple[list[str], list[float]]:
    """Feature names and weights of a fitted logistic model: a row's exact contributions are weight x feature."""
    return prep.stages[-1].getInputCols(), [float(c) for c in model.coefficients.toArray()]


def explain_fitted(prep, model):
    """``df -> df with attrib``: exact log-odds attributions of a fitted logistic model, on its prepared features."""
    from churnlab.operators.explain import attrib_rows

    names, weights = logistic_terms(prep, model)

    def fn(df: DataFrame) -> DataFrame:
        t = prep.transform(df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        t = t.select("_row.*", vector_to_array("features").alias("_x"))
        rows = attrib_rows(t, {n: F.coalesce(F.get("_x", F.lit(i)), F.lit(0.0)) * w for i, (n, w) in enumerate(zip(names, weights, strict=True))})
        return rows.drop("_x")
    return fn


def score(df: DataFrame, score_fn, threshold: float = 0.5, key: str = "customer_id") -> DataFrame:
    """p, label at the threshold, risk tier and Wilson interval for every row (no batch limit)."""
    s = score_fn(df)
    ci = fx.wilson_interval(F.col("p"))
    return s.select(key, F.col("p").alias("churn_probability"), (F.col("p") >= threshold).cast("int").alias("predicted_churn"),
                    fx.risk_tier(F.col("p")).alias("risk_tier"), ci.alias("interval"),
                    fx.is_uncertain_width(ci).alias("is_uncertain"))


def score_guard(df: DataFrame, expected_cols, expected_types: dict | None = None) -> DataFrame:
    """Fail closed: refuse to score a table that lacks a fitted input column or has a different type."""
    missing = [c for c in expected_cols if c not in df.columns]
    if missing:
        raise ValueError(f"cannot score: missing columns {missing}")
    for c, t in (expected_types or {}).items():
        if df.schema[c].dataType.simpleString() != t:
            raise ValueError(f"cannot score: column {c} is {df.schema[c].dataType.simpleString()}, expected {t}")
    return df


def batch_score_tiers(df: DataFrame, score_fn, min_p: float = 0.70, key: str = "customer_id") -> DataFrame:
    s = score(df, score_fn, key=key)
    return s.filter(F.col("churn_probability") >= min_p)


def _parallel(tasks, parallelism: int):
    """Run independent fits concurrently from driver threads (as Spark's CrossValidator does)."""
    from concurrent.futures import ThreadPoolExecutor
    if parallelism <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        return list(ex.map(lambda t: t(), tasks))


def _with_prob(df: DataFrame, mdl, name: str) -> DataFrame:
    t = mdl.transform(df)
    return t.withColumn(name, prob_of(t)).drop("rawPrediction", "probability", "prediction")


def fit_stacking(m: DataFrame, learners: dict, y: str = "churned", key: str = "customer_id", k: int = 5, seed: int = 42,
                 parallelism: int = 4):
    """Out-of-fold probabilities of each base learner -> logistic meta learner; bases refitted on all rows.

    A learner is a fit function or :class:`BoostParams`; boosted ones are trained together, folds and final fits alike,
    the others' fits run concurrently."""
    folded = stratified_folds(m, y, key, k, seed)
    folded = folded.coalesce(training_width(m)).persist()  # fits run one job per step: few, full partitions
    names = list(learners)
    boosted = [n for n in names if isinstance(learners[n], BoostParams)]
    todo = [(f, n) for n in boosted for f in [*range(k), None]]
    models = dict(zip(todo, fit_many(folded, [(learners[n], f) for f, n in todo], y, key)[0] if todo else []))
    jobs = [(f, n) for n in names if n not in boosted for f in [*range(k), None]]
    models.update(zip(jobs, _parallel([lambda f=f, n=n: learners[n](m if f is None else folded.filter(F.col("fold") != f)) for f, n in jobs], parallelism)))
    oof = None
    for f in range(k):
        part = folded.filter(F.col("fold") == f).select(key, y, "features")
        for n in names:
            part = _with_prob(part, models[(f, n)], f"p_{n}")
        part = part.drop("features")
        oof = part if oof is None else oof.unionByName(part)
    from pyspark.ml.feature import VectorAssembler
    meta_in = class_weights(VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="meta").transform(oof), y)
    meta = LogisticRegression(featuresCol="meta", labelCol=y, weightCol="weight", maxIter=500).fit(meta_in)
    bases = {n: models[(None, n)] for n in names}
    folded.unpersist()
    return bases, meta, oof


def stacking_score(df: DataFrame, bases: dict, meta, key: str = "customer_id") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    s = df
    for n, mdl in bases.items():
        s = _with_prob(s, mdl, f"p_{n}")
    s = VectorAssembler(inputCols=[f"p_{n}" for n in bases], outputCol="meta").transform(s)
    r = meta.transform(s)
    return r.select(key, *[f"p_{n}" for n in bases], prob_of(r).alias("p"))


# Search ranges of the boosted-tree tuning; "log" is drawn on a logarithmic scale, whole numbers as such.
TUNE_SPACE = {
    "xgboost": {"rounds": (100, 600), "depth": (3, 10), "rate": (0.01, 0.3, "log"), "subsample": (0.6, 1.0), "columns": (0.5, 1.0),
                "min_weight": (1, 10), "gamma": (0.0, 5.0), "alpha": (0.0, 2.0), "lam": (0.5, 5.0), "pos_weight": (1.0, 5.0)},
    "lightgbm": {"rounds": (100, 600), "leaves": (20, 150), "depth": (3, 12), "rate": (0.01, 0.3, "log"), "subsample": (0.6, 1.0),
                 "columns": (0.5, 1.0), "min_rows": (5, 50), "alpha": (0.0, 2.0), "lam": (0.0, 5.0)},
}
TUNE_FIXED = {"xgboost": {}, "lightgbm": {"balanced": True, "min_weight": 1e-3}}


def tune_trials(learner: str = "xgboost", trials: int = 30, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)

    def draw(lo, hi, scale=None):
        if scale == "log":
            return math.exp(rng.uniform(math.log(lo), math.log(hi)))
        return rng.randint(lo, hi) if isinstance(lo, int) else rng.uniform(lo, hi)

    return [{name: draw(*span) for name, span in TUNE_SPACE[learner].items()} for _ in range(trials)]


def tune(m: DataFrame, y: str = "churned", trials: int = 30, k: int = 5, seed: int = 42, timeout_s: float | None = 600,
         key: str = "customer_id", learner: str = "xgboost", batch: int | None = None) -> DataFrame:
    """Seeded random search over the learner's ranges, scored by k-fold exact AUC on left-out rows; one row per finished trial.

    The trials x folds models of a ``batch`` of trials (None: all) are trained together; with ``timeout_s`` the time is
    checked between batches."""
    import time
    drawn = tune_trials(learner, trials, seed)
    batch = batch or (trials if timeout_s is None else 5)
    folded = cut_lineage(stratified_folds(m, y, key, k, seed))
    edges = bin_edges(folded)
    res, t0, got = [], time.time(), {}
    for lo in range(0, trials, batch):
        some = drawn[lo:lo + batch]
        jobs = [(BoostParams(seed=seed, **TUNE_FIXED[learner], **p), f) for p in some for f in range(k)]
        _, scored = fit_many(folded, jobs, y, key, edges=edges, held_out=True)
        auc = auc_roc(scored, "y", "p", by=["job"]).select((F.floor(F.col("job") / k) + lo).cast("int").alias("trial"), "auc_roc")
        got.update({r["trial"]: r["a"] for r in auc.groupBy("trial").agg(F.avg("auc_roc").alias("a")).collect()})  # one number a trial
        if timeout_s is not None and time.time() - t0 > timeout_s:
            break
    names = list(TUNE_SPACE[learner])
    best = max(got.values())
    for t in sorted(got):
        res.append((t, *[float(drawn[t][n]) for n in names], float(got[t]), got[t] == best))
    return m.sparkSession.createDataFrame(res, ", ".join(["trial int", *[f"{n} double" for n in names], "cv_auc double", "best boolean"]))


def train_all(train: DataFrame, test: DataFrame, y: str = "churned", key: str = "customer_id", learners: dict | None = None) -> DataFrame:
    """Fit every learner (a fit function, or the name of a boosting preset) on train, exact AUC on test, ordered by AUC (rank 1 = selected)."""
    prep, m = prepare(train, y)
    t = prep.transform(test)
    learners = learners or {"logistic_regression": fit_logreg, "random_forest": fit_forest, "xgboost": "xgboost", "lightgbm": "lightgbm"}
    res = None
    presets = [n for n, f in learners.items() if isinstance(f, str)]  # boosted: trained together, beside the others

    def boosted() -> dict:
        return dict(zip(presets, fit_boosted_many(m, [learners[n] for n in presets], y, key=key).values()))

    jobs = [*[lambda n=n: {n: learners[n](m)} for n in learners if n not in presets], *([boosted] if presets else [])]
    got = {n: mdl for part in _parallel(jobs, 4) for n, mdl in part.items()}
    fitted = {n: got[n] for n in learners}
    for name, mdl in fitted.items():
        s = mdl.transform(t).select(F.col(y), prob_of(t).alias("p"))
        a = auc_roc(s, y, "p").select(F.lit(name).alias("model"), "auc_roc")
        res = a if res is None else res.unionByName(a)
    return res.withColumn("rank", F.rank().over(Window.orderBy(F.col("auc_roc").desc(), F.col("model"))))  # one row per learner


def registry_current(events: DataFrame) -> DataFrame:
    """Current stage per model version = latest registry event of that version (append-only event log)."""
    w = Window.partitionBy("version").orderBy(F.col("seq").desc())
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select("version", "model", "stage", "auc_roc")
