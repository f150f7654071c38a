"""Spark ML fits, stacking, tuning, sampled explanations and searched counterfactuals (rows-only checks).

Registered configurations: boosted trees use the presets' 300 rounds (200 in stacking); ``tune`` runs the library's
30 trials with 5 folds over the whole search space, without a time budget so that its output is reproducible.
"""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlab.operators import explain as X
from churnlab.operators import frames as FR
from churnlab.operators import models as MD
from churnlab.operators import prep as PR
from churnlab.operators import search as SE
from churnlab.operators.metrics import auc_roc
from churnlab.plans.oracle import C360, with_c360
from churnlab.plans.registry import out, register
from churnlab.session import cut_lineage, ensure_checkpoint_dir
from churnlab.sources.tables import customer360_table as customer360

STACK_ROUNDS = 200
NEIGHBOURS = 5000  # of a local surrogate's fit
FRESH_NEIGHBOURS = 500  # on which its fidelity is measured
SC_COLS = [c for c, _ in MD.LOGIT_WEIGHTS] + ["usage_30d", "usage_90d"]
_CACHE: dict = {}


def c360(spark, sf):
    return customer360(spark, sf)


def split(spark, sf):
    """Train/test split written once as parquet tables: every estimator fit and transform reads them
    instead of re-deriving the windowed split."""
    tr, te = PR.stratified_split(c360(spark, sf), "churned", "customer_id", test=0.2, seed=42)
    return cut_lineage(tr), cut_lineage(te)


def prepared(spark, sf):
    """Fitted preparation + weighted training matrix, persisted once per session and scale."""
    k = (id(spark), sf)
    if k not in _CACHE:
        tr, te = split(spark, sf)
        prep, m = MD.prepare(tr)
        m = m.select("customer_id", "churned", "weight", "features").persist()
        _CACHE[k] = (prep, m, te)
    return _CACHE[k]


def _sc_inputs(d):
    return d.select("customer_id", "contract_type", *SC_COLS)


_RANK_SQL = ("rk AS (SELECT customer_id, churned, COUNT(*) OVER (PARTITION BY churned) AS n, ROW_NUMBER() OVER (PARTITION BY churned "
             "ORDER BY CAST(('0x' || substr(md5('42:' || CAST(customer_id AS VARCHAR)), 1, 15)) AS BIGINT), customer_id) AS r FROM c360)")


@register("stratified_split", with_c360("SELECT customer_id, churned, CASE WHEN r <= CEIL(n * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM rk", _RANK_SQL))
def q_split(spark, sf):
    r = PR.stratified_rank(c360(spark, sf), "churned", "customer_id")
    return r.select("customer_id", "churned", F.when(F.col("_rank") <= F.ceil(F.col("_n_class") * 0.2), "test").otherwise("train").alias("split"))


@register("stratified_folds", with_c360("SELECT customer_id, churned, CAST((r - 1) % 5 AS INTEGER) AS fold FROM rk", _RANK_SQL))
def q_folds(spark, sf):
    return PR.stratified_folds(c360(spark, sf).select("customer_id", "churned"), "churned", "customer_id", k=5)


@register("prep_pipeline")
def q_prep(spark, sf):
    prep, _, te = prepared(spark, sf)
    return out(prep.transform(te).select("customer_id", vector_to_array("features").alias("features")))


def _coef_table(names, coefs, intercept=None):
    rows = [(n, float(c)) for n, c in zip(names, coefs)]
    if intercept is not None:
        rows.append(("(intercept)", float(intercept)))
    return rows


def _feature_names(prep):
    return prep.stages[-1].getInputCols()


@register("fit_logreg")
def q_logreg(spark, sf):
    prep, m, _ = prepared(spark, sf)
    mdl = MD.fit_logreg(m)
    return out(spark.createDataFrame(_coef_table(_feature_names(prep), mdl.coefficients.toArray(), mdl.intercept), "feature string, coef double"))


@register("fit_forest")
def q_forest(spark, sf):
    prep, m, _ = prepared(spark, sf)
    mdl = MD.fit_forest(m, trees=300)
    return out(spark.createDataFrame(_coef_table(_feature_names(prep), mdl.featureImportances.toArray()), "feature string, importance double"))


@register("fit_boosted")
def q_boosted(spark, sf):
    prep, m, te = prepared(spark, sf)
    res = None
    t = prep.transform(te)
    for preset, mdl in MD.fit_boosted_many(m, ("xgboost", "lightgbm")).items():
        s = mdl.transform(t).select("churned", MD.prob_of(t).alias("p"))
        a = auc_roc(s, "churned", "p").select(F.lit(preset).alias("preset"), "auc_roc")
        res = a if res is None else res.unionByName(a)
    return out(res)


def _learners():
    return {"xgboost": MD.boost_params("xgboost", rounds=STACK_ROUNDS), "lightgbm": MD.boost_params("lightgbm", rounds=STACK_ROUNDS),
            "random_forest": lambda d: MD.fit_forest(d, trees=200)}


@register("fit_stacking")
def q_stacking(spark, sf):
    prep, m, te = prepared(spark, sf)
    bases, meta, _ = MD.fit_stacking(m, _learners(), k=5)
    t = prep.transform(te)
    s = MD.stacking_score(t, bases, meta).join(t.select("customer_id", "churned"), "customer_id")
    return out(auc_roc(s, "churned", "p").select(F.lit("stacking").alias("model"), "auc_roc"))


@register("train_all")
def q_train_all(spark, sf):
    tr, te = split(spark, sf)
    return out(MD.train_all(tr, te))


@register("tune")
def q_tune(spark, sf):
    _, m, _ = prepared(spark, sf)
    return out(MD.tune(m, timeout_s=None))


REG_SQL = """
WITH {c360},
l AS (SELECT 'champion' AS model, churned, churn_probability AS score FROM c360 UNION ALL SELECT 'challenger', churned, challenger_probability FROM c360),
s AS (SELECT model, score, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM l GROUP BY 1, 2),
c AS (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY score) AS cum_neg FROM s),
a AS (SELECT model, SUM(pos * ((cum_neg - neg) + neg * 0.5e0)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS auc_roc FROM c GROUP BY model),
ev AS (
  SELECT 1 AS seq, 'v1' AS version, 'champion' AS model, 'Staging' AS stage FROM a WHERE model = 'champion'
  UNION ALL SELECT 2, 'v1', 'champion', 'Production' FROM a WHERE model = 'champion'
  UNION ALL SELECT 3, 'v2', 'challenger', 'Staging' FROM a WHERE model = 'challenger'
  UNION ALL SELECT 4, 'v2', 'challenger', 'Production' FROM (SELECT MAX(CASE WHEN model = 'challenger' THEN auc_roc END) AS ch,
    MAX(CASE WHEN model = 'champion' THEN auc_roc END) AS cp FROM a) AS x WHERE ch > cp + 0.005
  UNION ALL SELECT 5, 'v1', 'champion', 'Archived' FROM (SELECT MAX(CASE WHEN model = 'challenger' THEN auc_roc END) AS ch,
    MAX(CASE WHEN model = 'champion' THEN auc_roc END) AS cp FROM a) AS x WHERE ch > cp + 0.005)
SELECT version, ev.model, stage, ROUND(a.auc_roc, 6) AS auc_roc FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY version ORDER BY seq DESC) AS r FROM ev) AS ev JOIN a ON ev.model = a.model WHERE r = 1"""


def registry_events(spark, sf):
    """Append-only version events: register, promote, and (if the challenger wins by the margin) archive."""
    from churnlab.operators.metrics import leaderboard
    lb = leaderboard(c360(spark, sf), "churned", {"champion": "churn_probability", "challenger": "challenger_probability"})
    w = lb.groupBy().agg(F.max(F.when(F.col("model") == "champion", F.col("auc_roc"))).alias("cp"),
                         F.max(F.when(F.col("model") == "challenger", F.col("auc_roc"))).alias("ch"))
    promote = F.col("ch") > F.col("cp") + F.lit(0.005)
    def e(seq, version, model, stage, auc):
        return F.struct(F.lit(seq).alias("seq"), F.lit(version).alias("version"), F.lit(model).alias("model"),
                        F.lit(stage).alias("stage"), F.col(auc).alias("auc_roc"))
    ev = w.select(F.explode(F.array(
        e(1, "v1", "champion", "Staging", "cp"), e(2, "v1", "champion", "Production", "cp"), e(3, "v2", "challenger", "Staging", "ch"),
        F.when(promote, e(4, "v2", "challenger", "Production", "ch")),
        F.when(promote, e(5, "v1", "champion", "Archived", "cp")))).alias("e"))
    return ev.filter(F.col("e").isNotNull()).select("e.*")


@register("registry_table", REG_SQL.format(c360=C360))
def q_registry(spark, sf):
    return out(MD.registry_current(registry_events(spark, sf)))


# ---- sampled explanations on the scorecard --------------------------------------------------------
def _sc(spark, sf):
    d = c360(spark, sf)
    return d, MD.Scorecard.fit(d)


def _sampled(spark, sf):
    d, sc = _sc(spark, sf)
    bg = FR.sample_n(d, "customer_id", 100, seed=7).select(*SC_COLS, "contract_type")
    return X.attrib_sampled(d.select("customer_id", "contract_type", *SC_COLS), bg.select(*SC_COLS), SC_COLS, sc)


@register("attrib_sampled")
def q_attr_sampled(spark, sf):
    return out(_sampled(spark, sf))


@register("attrib_trees")
def q_attrib_trees(spark, sf):
    """Exact attributions of the boosted trees ("xgboost" preset, fitted on the training rows) over all customers."""
    prep, m, _ = prepared(spark, sf)
    rows = MD.fit_boosted(m, "xgboost").attributions(prep.transform(c360(spark, sf)), _feature_names(prep))
    return out(rows.select("customer_id", "base", "margin", F.explode("attrib").alias("a")).select("customer_id", "base", "margin", "a.feature", "a.value"))


@register("attrib_agreement")
def q_agreement(spark, sf):
    from churnlab.plans.q_ml import sc_terms
    d, sc = _sc(spark, sf)
    same = [k for k in sc_terms(sc) if k in SC_COLS]
    lin = X.attrib_linear(d, {k: v for k, v in sc_terms(sc).items() if k in same})
    return out(X.attrib_agreement(lin, _sampled(spark, sf).filter(F.col("feature").isin(same)), k=5))


def _every(spark, sf):
    """All customers are explained; the same table sets the scale of the perturbations."""
    d, sc = _sc(spark, sf)
    return d, sc, _sc_inputs(d)


@register("surrogate_local")
def q_surrogate(spark, sf):
    d, sc, x = _every(spark, sf)
    return out(X.surrogate_local(x, SC_COLS, sc, n=NEIGHBOURS, train=d).select("customer_id", "intercept", "weights", "local_pred"))


@register("surrogate_fidelity")
def q_fidelity(spark, sf):
    d, sc, x = _every(spark, sf)
    sur = cut_lineage(X.surrogate_local(x, SC_COLS, sc, n=NEIGHBOURS, train=d))
    return out(X.surrogate_fidelity(x, sur, SC_COLS, sc, n=FRESH_NEIGHBOURS, train=d))


def _stability(spark, sf):
    """Queries: every customer whose id is divisible by 50, against all customers."""
    from churnlab.plans.q_ml import sc_terms
    d, sc = _sc(spark, sf)
    rows = X.attrib_rows(d, sc_terms(sc)).select("customer_id", "attrib")
    corpus = d.select("customer_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in SC_COLS])
    q = corpus.filter(F.col("customer_id") % 50 == 0).withColumnRenamed("customer_id", "query_id")
    return X.attrib_stability(rows, SE.knn_euclid(q, corpus, SC_COLS, 10))


@register("attrib_stability")
def q_stability(spark, sf):
    return out(_stability(spark, sf))


def explained_instances(spark, sf):
    """customer_id, fidelity, stability, agreement, churn_prob of the instances of the stability search."""
    from churnlab.plans.q_ml import sc_terms
    d, sc = _sc(spark, sf)
    inst = cut_lineage(_sc_inputs(d.filter(F.col("customer_id") % 50 == 0)))
    sur = cut_lineage(X.surrogate_local(inst, SC_COLS, sc, n=NEIGHBOURS, train=d))
    fid = X.surrogate_fidelity(inst, sur, SC_COLS, sc, n=FRESH_NEIGHBOURS, train=d).select("customer_id", "fidelity")
    lin = X.attrib_linear(d.filter(F.col("customer_id") % 50 == 0), {k: v for k, v in sc_terms(sc).items() if k in SC_COLS})
    loc = X.surrogate_attrib(sur, SC_COLS).filter(F.col("feature").isin([k for k in sc_terms(sc) if k in SC_COLS]))  # the same features
    st = _stability(spark, sf).withColumnRenamed("query_id", "customer_id")
    p = sc(inst).select("customer_id", F.col("p").alias("churn_prob"))
    return fid.join(st, "customer_id").join(X.attrib_agreement(lin, loc, k=5), "customer_id").join(p, "customer_id")


@register("explain_benchmark_instances")
def q_bench_rows(spark, sf):
    return out(explained_instances(spark, sf))


@register("explain_benchmark")
def q_bench(spark, sf):
    m = ["fidelity", "stability", "agreement"]
    return out(explained_instances(spark, sf).agg(F.count(F.lit(1)).alias("n_instances"), *[F.avg(c).alias(f"mean_{c}") for c in m],
                                                  *[F.stddev_pop(c).alias(f"std_{c}") for c in m]))


def fitted(spark, sf):
    """A logistic model fitted on the training rows, written, and read back for scoring."""
    prep, m, _ = prepared(spark, sf)
    return MD.load_fitted(MD.save_fitted(prep, MD.fit_logreg(m), f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"))


@register("score_fitted")
def q_score_fitted(spark, sf):
    s = MD.score(c360(spark, sf), MD.ml_score_fn(*fitted(spark, sf)))
    return out(s.select("customer_id", "churn_probability", "predicted_churn", "risk_tier", F.col("interval.lower").alias("ci_lower"),
                        F.col("interval.upper").alias("ci_upper")))


@register("attrib_fitted")
def q_attrib_fitted(spark, sf):
    rows = MD.explain_fitted(*fitted(spark, sf))(c360(spark, sf))
    return out(rows.select("customer_id", F.explode("attrib").alias("a")).select("customer_id", "a.feature", "a.value"))


@register("retention_run_fitted")
def q_run_fitted(spark, sf):
    from churnlab.operators.decide import CATALOGUE_A
    from churnlab.plans.retention import retention_run
    prep, model = fitted(spark, sf)
    return out(retention_run(c360(spark, sf), MD.ml_score_fn(prep, model), MD.explain_fitted(prep, model), CATALOGUE_A, budget=300.0))


CF_FEATURES = [*SC_COLS, "monthly_charges", "contract_type", "plan_tier"]


def _cf_found(spark, sf):
    d, sc = _sc(spark, sf)
    return d, sc, X.cf_search(d, d.select(*CF_FEATURES), CF_FEATURES, sc, n=10)  # every customer is a donor


@register("cf_search")
def q_cf_search(spark, sf):
    _, _, found = _cf_found(spark, sf)
    return out(found.select("customer_id", "cand", F.array_join("changed", ",").alias("changed"), "new_churn_prob"))


@register("cf_cost")
def q_cf_cost(spark, sf):
    d, sc, found = _cf_found(spark, sf)
    return out(X.cf_cost(found, sc(d.drop("churn_probability")).withColumnRenamed("p", "churn_probability")))
