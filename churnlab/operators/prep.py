"""Preparation fitted on data, as Spark ML estimators (so they compose in a ``Pipeline``).

Fitting computes exact percentiles with running counts (no group buffers);
what reaches the driver is bounded by features x 3 numbers.  Transforms are
plain column expressions (codegen, no UDF).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.functions import features as fx
from churnlab.operators.prefix import prefix_sum
from churnlab.operators.select import exact_quantiles


def fit_percentiles(df: DataFrame, cols, probs, relative_error: float = 0.0) -> dict[str, dict[float, float]]:
    """{feature: {prob: value}} — bounded by len(cols) x len(probs).

    ``relative_error`` 0: exact linear-interpolation percentiles (ranks narrowed by sketches and counts);
    > 0: Spark's one-pass ``approxQuantile`` for all columns at once (Greenwald-Khanna).
    """
    if relative_error > 0:
        qs = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(list(cols), list(probs), relative_error)
        return {c: {round(p, 9): v for p, v in zip(probs, q)} for c, q in zip(cols, qs)}
    got = exact_quantiles(df, cols, list(probs))
    return {c: {round(p, 9): v for p, v in got.get(c, {}).items()} for c in cols}


class _RelErr(Params):
    relativeError = Param(Params._dummy(), "relativeError", "0 = exact percentiles, > 0 = approxQuantile",
                          typeConverter=TypeConverters.toFloat)


class _Floats(Params):
    values = Param(Params._dummy(), "values", "fitted numbers, flattened", typeConverter=TypeConverters.toListFloat)


class IQRCapper(Estimator, HasInputCols, _RelErr, DefaultParamsReadable, DefaultParamsWritable):
    """Clip each column to [Q1 - f*IQR, Q3 + f*IQR] (0/1 columns are left alone by the caller)."""
    factor = Param(Params._dummy(), "factor", "IQR multiple", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, factor=1.5, relativeError=0.0):
        super().__init__()
        self._setDefault(factor=1.5, relativeError=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols, f = self.getInputCols(), self.getOrDefault(self.factor)
        q = fit_percentiles(df, cols, [0.25, 0.75], self.getOrDefault(self.relativeError))
        vals = []
        for c in cols:
            q1, q3 = q[c].get(0.25), q[c].get(0.75)
            if q1 is None:
                vals += [float("nan"), float("nan")]
            else:
                vals += [q1 - f * (q3 - q1), q3 + f * (q3 - q1)]
        return IQRCapperModel(inputCols=cols, values=vals)


class IQRCapperModel(Model, HasInputCols, _Floats, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        v = self.getOrDefault(self.values)
        rep = {}
        for i, c in enumerate(self.getInputCols()):
            lo, hi = v[2 * i], v[2 * i + 1]
            if lo == lo:  # not NaN
                rep[c] = fx.clip(F.col(c), lo, hi)
        return df.withColumns(rep)


class MedianImputer(Estimator, HasInputCols, _RelErr, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, relativeError=0.0):
        super().__init__()
        self._setDefault(relativeError=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getInputCols()
        q = fit_percentiles(df, cols, [0.5], self.getOrDefault(self.relativeError))
        return MedianImputerModel(inputCols=cols, values=[q[c].get(0.5, float("nan")) for c in cols])


class MedianImputerModel(Model, HasInputCols, _Floats, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        v = self.getOrDefault(self.values)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v[i] if v[i] == v[i] else 0.0))
                               for i, c in enumerate(self.getInputCols())})


class IQRScaler(Estimator, HasInputCols, _RelErr, DefaultParamsReadable, DefaultParamsWritable):
    """(x - median) / (Q3 - Q1); an IQR of 0 scales by 1."""
    @keyword_only
    def __init__(self, inputCols=None, relativeError=0.0):
        super().__init__()
        self._setDefault(relativeError=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getInputCols()
        q = fit_percentiles(df, cols, [0.25, 0.5, 0.75], self.getOrDefault(self.relativeError))
        vals = []
        for c in cols:
            med = q[c].get(0.5, 0.0)
            iqr = (q[c].get(0.75, 0.0) - q[c].get(0.25, 0.0)) if q[c] else 0.0
            vals += [med, iqr if iqr != 0 else 1.0]
        return IQRScalerModel(inputCols=cols, values=vals)


class IQRScalerModel(Model, HasInputCols, _Floats, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        v = self.getOrDefault(self.values)
        return df.withColumns({c: (F.col(c) - F.lit(v[2 * i])) / F.lit(v[2 * i + 1]) for i, c in enumerate(self.getInputCols())})


class OneHotDropFirst(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Sorted categories per column, first one dropped; an unseen category encodes as all zeros."""
    maxCategories = Param(Params._dummy(), "maxCategories", "cardinality guard", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, maxCategories=1000):
        super().__init__()
        self._setDefault(maxCategories=1000)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols, cap = self.getInputCols(), self.getOrDefault(self.maxCategories)
        kv = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])).alias("kv"))
        d = kv.select("kv.*").filter(F.col("v").isNotNull()).distinct()
        counts = {r["c"]: r["n"] for r in d.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        if any(n > cap for n in counts.values()):
            raise ValueError(f"a categorical column has more than {cap} categories")
        rows = d.collect()  # bounded by the guard above
        cats = {c: sorted(r["v"] for r in rows if r["c"] == c) for c in cols}
        return OneHotDropFirstModel(inputCols=cols, categories=[f"{c}\u0001{v}" for c in cols for v in cats[c][1:]])


class OneHotDropFirstModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    categories = Param(Params._dummy(), "categories", "column\\x01value pairs kept", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, categories=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def outputCols(self):
        return [cv.replace("\u0001", "_").replace(" ", "_").replace("-", "_") for cv in self.getOrDefault(self.categories)]

    def _transform(self, df):
        new = {}
        for cv, name in zip(self.getOrDefault(self.categories), self.outputCols()):
            c, v = cv.split("\u0001", 1)
            new[name] = F.when(F.col(c) == v, 1.0).otherwise(0.0)
        return df.withColumns(new)


class FeatureAdder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df):
        return fx.add_features(df)


# 0/1 derived columns left out of IQR capping (their IQR is often 0).
BINARY = ["support_escalation_flag"]
NUMERIC = fx.RAW_NUMERIC + fx.DERIVED


def prep_pipeline(numeric=NUMERIC, categorical=fx.CATEGORICAL, output: str = "features", relative_error: float = 1e-3) -> Pipeline:
    """features -> IQR cap -> one-hot (drop first) -> median impute -> IQR scale -> assemble.

    For model training the percentiles come from one-pass ``approxQuantile`` (``relative_error``);
    pass 0 for exact percentiles."""
    capped = [c for c in numeric if c not in BINARY]
    onehot = OneHotDropFirst(inputCols=list(categorical))
    return Pipeline(stages=[FeatureAdder(), IQRCapper(inputCols=capped, relativeError=relative_error), onehot,
                            MedianImputer(inputCols=list(numeric), relativeError=relative_error),
                            IQRScaler(inputCols=list(numeric), relativeError=relative_error), _Assemble(numeric=list(numeric), output=output)])


class _Assemble(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Assemble numeric + one-hot columns (names known only after the one-hot fit)."""
    numeric = Param(Params._dummy(), "numeric", "numeric columns", typeConverter=TypeConverters.toListString)
    output = Param(Params._dummy(), "output", "vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, numeric=None, output="features"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df):
        num = self.getOrDefault(self.numeric)
        oh = [c for c in df.columns if any(c.startswith(p + "_") for p in fx.CATEGORICAL) and c not in num]
        return _AssembleModel(inputCols=num + sorted(oh), output=self.getOrDefault(self.output))


class _AssembleModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    output = Param(Params._dummy(), "output", "vector column", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, output="features"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return VectorAssembler(inputCols=self.getInputCols(), outputCol=self.getOrDefault(self.output), handleInvalid="keep").transform(df)


# ---------------------------------------------------------------------------------------------
# splits and weights
# ---------------------------------------------------------------------------------------------
def _hash_key(key: str, seed: int):
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("bigint")


def stratified_rank(df: DataFrame, y: str, key: str, seed: int = 42) -> DataFrame:
    """Rank (1..n_class) of each row inside its label in a seeded hash order, plus the class size.
    Uses the bucketed running sums, so a class is never ranked in a single task."""
    d = df.withColumn("_h", _hash_key(key, seed)).withColumn("_one", F.lit(1))
    r = prefix_sum(d, "_h", ["_one"], by=[y], tiebreak=[F.col(key).asc()], totals=True)
    return r.withColumnRenamed("cum__one", "_rank").withColumnRenamed("tot__one", "_n_class").drop("_one")


def stratified_split(df: DataFrame, y: str, key: str, test: float = 0.2, seed: int = 42):
    """Exact per-class shares: the first ceil(test * n_class) rows of each class (hash order) go to test."""
    r = stratified_rank(df, y, key, seed)
    is_test = F.col("_rank") <= F.ceil(F.col("_n_class") * F.lit(test))
    cols = df.columns
    return r.filter(~is_test).select(*cols), r.filter(is_test).select(*cols)


def stratified_folds(df: DataFrame, y: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    r = stratified_rank(df, y, key, seed)
    return r.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_n_class", "_h")


def class_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (2 * n_class); the class table has two rows and is broadcast."""
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"))
    tot = df.agg(F.count(F.lit(1)).alias("_n"))
    w = n.crossJoin(tot).select(y, (F.col("_n") / (2.0 * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), y)
