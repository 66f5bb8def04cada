"""Baselines and MLlib models (survey M1-M20, M25, M27, M30-M32).

Fits are distributed MLlib jobs over cached, assembled feature vectors;
scoring is a ``transform`` (JVM-side), never a Python UDF.  Evaluation
is one aggregate per model over a long (model, pred) table.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecast.operators import aggregates as A
from ratecast.operators.quantiles import group_quantiles, quantiles
from ratecast.operators.trees import TreeSum, column_slots, matrix, tree_sum
from ratecast.operators.windows import global_index
from ratecast.session import written


def constant_baselines(df: DataFrame, actual: str, train_mean: str) -> DataFrame:
    """M2: MAE of the train-mean constant, of zero, and of the oracle
    constant (the evaluated rows' own mean)."""
    oracle = df.agg(F.avg(actual)).scalar()
    a = F.col(actual)
    one = df.agg(F.avg(F.abs(F.col(train_mean) - a)).alias("global"), F.avg(F.abs(F.lit(0.0) - a)).alias("zero"),
                 F.avg(F.abs(oracle - a)).alias("oracle"))
    return one.selectExpr("stack(3, 'global', `global`, 'zero', `zero`, 'oracle', `oracle`) AS (model, mae)")


# M1 ----------------------------------------------------------------------------
class Standardise(Estimator):
    """(x - mean) / sample deviation of each column, 0 for a column without
    spread: what StandardScaler gives, but the scaled values stay columns, so
    a row is made into a vector once, by the last stage."""

    def __init__(self, cols: Sequence[str], outs: Sequence[str]):
        super().__init__()
        self.cols, self.outs = list(cols), list(outs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        x = array_to_vector(F.array(*[F.col(c).cast("double") for c in self.cols]))
        found = dataset.select(Summarizer.metrics("mean", "std").summary(x).alias("s")).first()["s"]
        parts = []
        for c, out, mean, std in zip(self.cols, self.outs, found["mean"].toArray(), found["std"].toArray()):
            factor = 1.0 / float(std) if std else 0.0
            parts.append(f"(`{c}` - CAST('{float(mean)!r}' AS DOUBLE)) * CAST('{factor!r}' AS DOUBLE) AS `{out}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def preprocessor(num: Sequence[str], bools: Sequence[str] = (), cats: Sequence[str] = (),
                 scale: bool = True, out: str = "features") -> Pipeline:
    """Median-impute + standardise numerics, booleans as 0/1 (null -> 0),
    categoricals indexed (unseen levels kept as an extra index that the
    encoder drops, i.e. all-zero like an ignoring one-hot) and one-hot."""
    stages = []
    imp = [f"_imp_{c}" for c in num]
    nums = [f"_num_s_{i}" for i in range(len(num))] if scale else imp
    if num:
        stages.append(Imputer(strategy="median", inputCols=list(num), outputCols=imp))
        if scale:
            stages.append(Standardise(imp, nums))
    if bools:
        sel = ", ".join(f"CAST(coalesce(`{b}`, false) AS DOUBLE) AS `_b_{b}`" for b in bools)
        stages.append(SQLTransformer(statement=f"SELECT *, {sel} FROM __THIS__"))
    oh = []
    if cats:
        idx = [f"_idx_{c}" for c in cats]
        oh = [f"_oh_{c}" for c in cats]
        stages.append(StringIndexer(inputCols=list(cats), outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True, handleInvalid="keep"))
    parts = nums + [f"_b_{b}" for b in bools] + oh
    stages.append(VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def sized(df: DataFrame, rows_per_partition: int = 2_000_000) -> DataFrame:
    """Repartition training data to as few times the default parallelism as
    keep to ``rows_per_partition``: iterative learners run one job per round,
    so many tiny partitions cost more than they parallelise, and a last wave
    of few tasks would leave the other cores idle in every round."""
    import math
    n = df.count()
    dp = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(dp * max(1, math.ceil(n / (rows_per_partition * dp))))


def fit_vectors(est, vectors: DataFrame):
    """Fit on the feature vectors and the label alone, held in memory for the
    learner's passes and released afterwards."""
    return fit_all([est], vectors)[0]


def fit_all(ests: Sequence, vectors: DataFrame) -> list:
    """Several learners, one after another, on the same held vectors."""
    x = sized(vectors.select(ests[0].getFeaturesCol(), ests[0].getLabelCol())).cache()
    try:
        return [est.fit(x) for est in ests]
    finally:
        x.unpersist()


def side_by_side(job: Callable, items: Sequence, at_once: int) -> list:
    """``job`` of each item, ``at_once`` at a time, in order of the items."""
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return [f.result() for f in [pool.submit(job, x) for x in items]]


# M4-M6 ---------------------------------------------------------------------------
MODEL_REGISTRY: dict[str, Callable[..., object]] = {
    "ridge": lambda label, **kw: LinearRegression(labelCol=label, regParam=kw.get("reg", 0.01), elasticNetParam=0.0),
    "lasso": lambda label, **kw: LinearRegression(labelCol=label, regParam=kw.get("reg", 0.01), elasticNetParam=1.0),
    "elasticnet": lambda label, **kw: LinearRegression(labelCol=label, regParam=kw.get("reg", 0.01),
                                                       elasticNetParam=0.5),
    "huber": lambda label, **kw: LinearRegression(labelCol=label, loss="huber", regParam=kw.get("reg", 0.01)),
    "decision_tree": lambda label, **kw: DecisionTreeRegressor(labelCol=label, maxDepth=kw.get("depth", 6),
                                                               minInstancesPerNode=kw.get("leaf", 1), seed=42),
    "random_forest": lambda label, **kw: RandomForestRegressor(
        labelCol=label, numTrees=kw.get("trees", 40), maxDepth=kw.get("depth", 8), minInstancesPerNode=kw.get("leaf", 1),
        featureSubsetStrategy=str(kw.get("features", "auto")), seed=42),
    "gbt": lambda label, **kw: GBTRegressor(
        labelCol=label, maxIter=kw.get("iters", 30), maxDepth=kw.get("depth", 4), stepSize=kw.get("step", 0.1),
        minInstancesPerNode=kw.get("leaf", 1), subsamplingRate=kw.get("subsample", 1.0),
        featureSubsetStrategy=str(kw.get("features", "all")), seed=42),
}


def register_model(name: str, factory: Callable[..., object]) -> None:
    MODEL_REGISTRY[name] = factory


def make_model(name: str, label: str, **params):
    return MODEL_REGISTRY[name](label, **params)


def compare_models(train: DataFrame, test: DataFrame, label: str, id_col: str, num, bools, cats,
                   names: Sequence[str], params: dict | None = None):
    """M12 over a registry: one shared preprocessing fit, every model fit
    on the same train vectors (in memory until all are fitted), the test
    vectors written once; failures isolated per model.  Returns (metrics DF, long predictions DF, fit seconds dict)."""
    prep = preprocessor(num, bools, cats).fit(train)
    tr = sized(prep.transform(train).select(id_col, label, "features")).cache()
    te = written(prep.transform(test).select(id_col, label, "features"), "test_vectors")
    preds, secs = None, {}
    for n in names:
        try:
            t0 = time.time()
            m = make_model(n, label, **(params or {}).get(n, {})).fit(tr)
            secs[n] = time.time() - t0
            p = m.transform(te).select(id_col, label, F.lit(n).alias("model"), F.col("prediction").alias("pred"))
            preds = p if preds is None else preds.unionByName(p)
        except Exception as e:  # noqa: BLE001 - a failing model must not stop the others
            secs[n] = f"failed: {type(e).__name__}"
    tr.unpersist()
    metrics = A.metrics(preds, label, "pred", by=["model"])
    return metrics, preds, secs


def train_eval_refit(df: DataFrame, label: str, date: str, num, bools, cats, frac: float = 0.2, model: str = "gbt",
                     **params) -> tuple[PipelineModel, DataFrame]:
    """Fit on the rows before the date cut, score the rest, then refit on
    all rows.  Returns the refitted pipeline and one row for the run log:
    rows, rows of each part, cut date, test MAE and R2."""
    from ratecast.operators.windows import date_cut
    cut = df.select(date_cut(df, date, frac).alias("c")).first()[0]
    day = F.to_date(date)
    train, test = df.where(day < F.lit(cut)), df.where(day >= F.lit(cut))

    def fit(rows):
        prep = preprocessor(num, bools, cats).fit(rows)
        return PipelineModel([prep, fit_vectors(make_model(model, label, **params), prep.transform(rows))])
    m = A.metrics(fit(train).transform(test).withColumnRenamed("prediction", "pred"), label, "pred").first()
    n = df.count()
    row = [(model, n, n - m["n"], m["n"], cut, float(m["mae"]), None if m["r2"] is None else float(m["r2"]))]
    log = df.sparkSession.createDataFrame(row, "model string, n_rows long, n_train long, n_test long, cut date, test_mae double, test_r2 double")
    return fit(df), log


# M14 ---------------------------------------------------------------------------
def feature_names(df_with_features: DataFrame, col: str = "features") -> list[str]:
    meta = df_with_features.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a["name"]) for group in meta.values() for a in group)
    return [n for _, n in slots]


def importance(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances or |coefficients| by slot name (small: one value
    per feature slot)."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    else:
        vals = [abs(x) for x in model.coefficients.toArray()]
    return sorted(zip(names, map(float, vals)), key=lambda x: -x[1])


# M13 ---------------------------------------------------------------------------
def conformal_interval(train: DataFrame, test: DataFrame, label: str, id_col: str, date: str, num, bools, cats,
                       by: Sequence[str] = (), cal_frac: float = 0.15, alpha: float = 0.2, miss_q: float = 0.9, model: str = "gbt"):
    """Split-conformal 80% interval: fit on the earlier train part, take
    per-segment residual quantiles as the raw P10/P90, then widen each side
    by max(0, the ``miss_q`` quantile of its signed misses) measured on the last
    ``cal_frac`` of train (by date).  Returns coverage before/after."""
    from ratecast.operators.windows import date_cut
    cut = date_cut(train, date, cal_frac)
    fit_part = train.where(F.to_date(date) < cut)
    cal = train.where(F.to_date(date) >= cut)
    prep = preprocessor(num, bools, cats).fit(fit_part)
    m = fit_vectors(make_model(model, label), prep.transform(fit_part))

    def score(df):
        return m.transform(prep.transform(df)).withColumnRenamed("prediction", "pred").drop("features")
    fitted = score(fit_part).withColumn("_res", F.col(label) - F.col("pred"))
    lo_q, hi_q = alpha / 2, 1 - alpha / 2
    if by:
        res_q = group_quantiles(fitted, by, "_res", [lo_q, hi_q], out="_q")
        res_q = res_q.select(*by, F.col("_q")[0].alias("_rlo"), F.col("_q")[1].alias("_rhi"))
    else:
        whole = quantiles(fitted, "_res", [lo_q, hi_q])

    def band(df):
        s = score(df)
        if by:
            s = s.join(res_q, list(by), "left")
        else:
            s = s.withColumn("_rlo", F.lit(whole[0])).withColumn("_rhi", F.lit(whole[1]))
        return s.withColumn("low", F.col("pred") + F.col("_rlo")).withColumn("high", F.col("pred") + F.col("_rhi"))
    c = band(cal)
    off_lo = max(0.0, quantiles(c, F.col("low") - F.col(label), [miss_q])[0] or 0.0)
    off_hi = max(0.0, quantiles(c, F.col(label) - F.col("high"), [miss_q])[0] or 0.0)
    t = band(test).withColumn("low_c", F.col("low") - off_lo).withColumn("high_c", F.col("high") + off_hi)
    y = F.col(label)
    return t.agg(F.count("*").alias("n"),
                 F.avg(y.between(F.col("low"), F.col("high")).cast("double")).alias("coverage_raw"),
                 F.avg(y.between(F.col("low_c"), F.col("high_c")).cast("double")).alias("coverage_conformal"),
                 F.avg(F.col("high_c") - F.col("low_c")).alias("mean_width"))


# M20 ---------------------------------------------------------------------------
def learning_curve(train: DataFrame, test: DataFrame, label: str, order: Sequence[str], num, bools, cats,
                   fracs: Sequence[float] = (0.1, 0.2, 0.3, 0.5, 0.65, 0.8, 0.95, 1.0), model: str = "gbt",
                   plateau: float = 0.003, min_rows: int = 100):
    """Fit on the earliest fraction of train (by the total order) and score
    test; ``plateau`` marks the last gain below the threshold.  Fractions of
    fewer than ``min_rows`` rows are left out."""
    n = train.agg(F.count("*")).first()[0]
    used = dict.fromkeys([*order, label, *num, *bools, *cats])
    indexed = written(global_index(train.select(*used), order, out="_rn"), "indexed")
    rows = []
    for f in fracs:
        if int(n * f) < min_rows:
            continue
        part = indexed.where(F.col("_rn") <= int(n * f)).drop("_rn")
        prep = preprocessor(num, bools, cats).fit(part)
        m = fit_vectors(make_model(model, label), prep.transform(part))
        p = m.transform(prep.transform(test))
        mae = p.agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]
        rows.append((float(f), int(n * f), float(mae)))
    out = train.sparkSession.createDataFrame(rows, "frac double, n_train long, mae double")
    last_gain = rows[-2][2] - rows[-1][2] if len(rows) > 1 else 0.0
    return out.withColumn("plateau", F.lit(bool(last_gain < plateau)))


# M25 ---------------------------------------------------------------------------
def cluster_errors(df: DataFrame, vec: str, err: str, q: float = 0.7, k: int = 5, seed: int = 42) -> DataFrame:
    """KMeans (k clusters) on the rows whose |error| is in the top 1-q."""
    thr, = quantiles(df, F.abs(F.col(err)), [q])
    hard = df.where(F.abs(F.col(err)) >= F.lit(thr).cast("double"))
    model = KMeans(k=k, seed=seed, featuresCol=vec, predictionCol="cluster").fit(hard)
    return model.transform(hard)


# M27 ---------------------------------------------------------------------------
def fit_additive(daily: DataFrame, date: str, value: str, regressors: Sequence[str], cut, k: int = 3,
                 period: float = 7.0):
    """Daily additive model: linear trend + Fourier weekly terms + regressors,
    least squares (normal equations); returns the scored test days with their
    ``trend`` and ``weekly`` parts, and the coefficients with the standard
    deviation of the weekly part over the train days."""
    from ratecast.functions.scalars import fourier
    start = daily.agg(F.min(date)).scalar()
    d = daily.withColumn("t", F.datediff(F.col(date), start).cast("double"))
    for name, c in fourier("t", period, k, prefix="w").items():
        d = d.withColumn(name, c)
    week = [f"w_{f}{i}" for f in ("sin", "cos") for i in range(1, k + 1)]
    feats = ["t", *week, *regressors]
    d = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep").transform(d)
    tr, te = d.where(F.col(date) < cut), d.where(F.col(date) >= cut)
    m = LinearRegression(labelCol=value, solver="normal", regParam=0.0).fit(tr)
    coefs = dict(zip(feats, map(float, m.coefficients.toArray())))
    coefs["intercept"] = float(m.intercept)
    weekly = sum((F.col(c) * F.lit(coefs[c]) for c in week), F.lit(0.0))
    coefs["weekly_amplitude"] = float(tr.agg(F.stddev_pop(weekly)).first()[0] or 0.0)
    scored = m.transform(te).withColumnRenamed("prediction", "pred")
    return scored.withColumn("trend", F.lit(coefs["intercept"]) + F.col("t") * F.lit(coefs["t"])).withColumn("weekly", weekly), coefs


# M32 ---------------------------------------------------------------------------
def series_baselines(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str], split: str, span: int = 4,
                     min_history: int = 2) -> DataFrame:
    """Per test row, from its own series: the train mean, the previous value
    and the EMA of the previous values (one-step, so test rows use the test
    rows before them).  Rows with fewer than ``min_history`` earlier rows are
    left out, of the train means too; a missing previous value or EMA gives
    the train mean, and a series without such train rows has no baseline."""
    from ratecast.operators.windows import ema, lags, running_totals
    x = running_totals(df, key, order, count_out="_seen")
    x = lags(x, key, value, order, ks=(1,), prefix="_lag")
    x = ema(x, key, value, order, span=span, out="_last_ema").where(F.col("_seen") >= min_history)
    means = (x.where(F.col(split) == "train").groupBy(*[F.col(k).alias(f"_m_{k}") for k in key])
             .agg(F.avg(value).alias("pred_mean")))
    x = x.where(F.col(split) == "test").join(means, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in key])
    x = x.withColumn("pred_last", F.coalesce("_lag_1", "pred_mean")).withColumn("pred_ema", F.coalesce("_last_ema", "pred_mean"))
    return x.drop("_seen", "_lag_1", "_last_ema", *[f"_m_{k}" for k in key])


# M8-M11, M15-M19 ---------------------------------------------------------------------
def routed(train: DataFrame, test: DataFrame, flag: str, label: str, num, bools, cats, min_rows: int = 50,
           model: str = "gbt") -> DataFrame:
    """A flagged-rows expert and a routine expert; with fewer than
    ``min_rows`` flagged train rows the flagged rows use the routine model."""
    f = F.coalesce(F.col(flag), F.lit(False))
    base_tr = train.where(~f)
    prep = preprocessor(num, bools, cats).fit(train)
    routine = fit_vectors(make_model(model, label), prep.transform(base_tr))
    n_flag = train.where(f).count()
    expert = fit_vectors(make_model(model, label), prep.transform(train.where(f))) if n_flag >= min_rows else routine
    a = routine.transform(prep.transform(test.where(~f)))
    b = expert.transform(prep.transform(test.where(f)))
    return a.unionByName(b).withColumnRenamed("prediction", "pred").drop("features")


def experts(train: DataFrame, test: DataFrame, by: str, label: str, num, bools, cats, min_train: int = 100,
            min_test: int = 10, model: str = "gbt", at_once: int = 4) -> DataFrame:
    """Per segment, an expert fit on that segment vs the central model,
    with both row counts, the change of MAE (negative: the expert is better)
    and the gain in percent of the central MAE.  Segments below the size
    limits are skipped.  All experts share one table of vectors, laid out by
    segment, and ``at_once`` of them are fitted at a time."""
    prep = preprocessor(num, bools, cats).fit(train)
    central = fit_vectors(make_model(model, label), prep.transform(train))
    path = [by, label, "features"]
    train_x = written(prep.transform(train).select(*path).repartition(by).sortWithinPartitions(by), "expert_vectors")
    test_x = written(central.transform(prep.transform(test).select(*path)).withColumnRenamed("prediction", "_central"), "expert_tests")
    sizes = (train.groupBy(by).agg(F.count("*").alias("ntr"))
             .join(test.groupBy(by).agg(F.count("*").alias("nte")), by)
             .where((F.col("ntr") >= min_train) & (F.col("nte") >= min_test)))
    segs = sizes.orderBy(by).collect()  # one row per segment
    y = F.col(label)

    def one(seg):
        s, n_train, n_test = seg
        expert = fit_vectors(make_model(model, label), train_x.where(F.col(by) == s))
        found = expert.transform(test_x.where(F.col(by) == s)).agg(F.avg(F.abs(F.col("_central") - y)), F.avg(F.abs(F.col("prediction") - y))).first()
        mc, me = map(float, found)
        return str(s), n_train, n_test, mc, me, me - mc, (mc - me) / mc * 100 if mc else None
    rows = side_by_side(one, segs, at_once)
    return train.sparkSession.createDataFrame(rows, "segment string, n_train long, n_test long, mae_central double, "
                                              "mae_expert double, delta double, gain_pct double")


def permutation_importance(model: PipelineModel, df: DataFrame, label: str, cols: Sequence[str], id_col: str,
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """Per column, the mean and standard deviation over ``repeats`` of the
    MAE increase when the column is permuted.  A permutation pairs each row's
    position in id order with a position in a seeded hash order (row indexes
    over pieces and equality joins).  Tree models are scored from the outcomes
    of their splits; for others all repeats and columns are scored in one
    job, each row as ``repeats`` x columns copies.  ``id_col`` is unique."""
    n = df.count()
    pos = global_index(df.select(F.col(id_col).alias("_to")), ["_to"], out="_p")
    reps = df.select(F.col(id_col).alias("_from"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_rep"))
    reps = reps.withColumn("_h", F.xxhash64("_from", "_rep", F.lit(seed)))
    drawn = global_index(reps, ["_rep", "_h", "_from"], out="_g").select("_rep", "_from", (F.col("_g") - F.col("_rep") * n).alias("_p"))
    pairs = drawn.join(pos, "_p").select("_rep", "_from", "_to")
    forest, slots = tree_sum(model.stages[-1]), column_slots(model, cols)
    if forest and forest.splits and slots is not None:
        sums = _permuted_tree_errors(model, forest, slots, df, pairs, label, id_col)
        base = model.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).scalar()
        per = sums.groupBy("feature", "_rep").agg((F.try_divide(F.sum("_err"), F.sum("_n")) - base).alias("_d"))
    else:
        err = F.avg(F.abs(F.col("prediction") - F.col(label)))
        base = model.transform(df).agg(err).scalar()
        values = df.select(F.col(id_col).alias("_from"), *[F.col(c).alias(f"_new_{c}") for c in cols])
        x = df.join(pairs.join(values, "_from").drop("_from"), F.col(id_col) == F.col("_to"))
        x = x.withColumn("feature", F.explode(F.array(*map(F.lit, cols))))
        for c in cols:
            x = x.withColumn(c, F.when(F.col("feature") == c, F.col(f"_new_{c}")).otherwise(F.col(c)))
        x = x.drop("_to", *[f"_new_{c}" for c in cols])
        per = model.transform(x).groupBy("feature", "_rep").agg((err - base).alias("_d"))
    return per.groupBy("feature").agg(F.avg("_d").alias("mae_increase"), F.stddev_pop("_d").alias("std"))


def _permuted_tree_errors(model: PipelineModel, forest: TreeSum, slots: dict[str, set[int]], df: DataFrame, pairs: DataFrame,
                          label: str, id_col: str) -> DataFrame:
    """Sums of absolute errors (``feature``, ``_rep``, ``_err``, ``_n``, per
    batch) with one column taken from the paired row.  Each row is prepared
    once and travels as the outcomes of the model's splits, a bit each; a
    column's trees are walked again with its own splits' bits of the paired row."""
    n_splits = len(forest.splits)
    own = {c: [s for s, (slot, _, _) in enumerate(forest.splits) if slot in of] for c, of in slots.items()}
    touched = {c: [t for t, tree in enumerate(forest.trees) if forest.used(tree) & set(ss)] for c, ss in own.items()}

    def bits(batches):
        for t in batches:
            if not t.num_rows:
                continue
            packed = np.packbits(forest.outcomes(matrix(t.column("_x"))), axis=0).T
            rows = [row.tobytes() for row in packed]
            yield pa.RecordBatch.from_pydict({"_id": t.column("_id"), "_y": t.column("_y"), "_bits": pa.array(rows, pa.binary())})

    def went(column, rows):
        packed = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(rows, -1)
        return np.unpackbits(np.ascontiguousarray(packed.T), axis=0, count=n_splits).astype(bool)

    def errors(batches):
        sums = {}
        for t in batches:
            n = t.num_rows
            if not n:
                continue
            y, rep = np.array(t.column("_y")), np.array(t.column("_rep"))
            mine, other = went(t.column("_bits"), n), went(t.column("_other"), n)
            parts = [forest.predict(tree, mine) for tree in forest.trees]
            whole = sum(parts) + np.zeros(n)
            reps, place = np.unique(rep, return_inverse=True)
            known = ~np.isnan(y)
            counts = np.bincount(place[known], minlength=len(reps))
            for c, ss in own.items():
                mixed = mine.copy()
                mixed[ss] = other[ss]
                pred = whole + sum(forest.predict(forest.trees[i], mixed) - parts[i] for i in touched[c])
                err = np.bincount(place[known], np.abs(pred - y)[known], minlength=len(reps))
                for r, e, k in zip(reps.tolist(), err.tolist(), counts.tolist()):
                    old = sums.get((c, r), (0.0, 0))
                    sums[c, r] = old[0] + e, old[1] + k
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({"feature": [c for c, _ in keys], "_rep": pa.array([r for _, r in keys], pa.int32()),
                                              "_err": [sums[k][0] for k in keys], "_n": [sums[k][1] for k in keys]})

    ready = model.stages[0].transform(df).select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y"),
                                                 vector_to_array("features").alias("_x"))
    id_type = df.schema[id_col].dataType.simpleString()
    rows = written(ready.mapInArrow(bits, f"_id {id_type}, _y double, _bits binary"), "outcomes")
    x = pairs.join(rows.select(F.col("_id").alias("_from"), F.col("_bits").alias("_other")), "_from")
    x = x.join(rows.withColumnRenamed("_id", "_to"), "_to").select("_rep", "_y", "_bits", "_other")
    return x.mapInArrow(errors, "feature string, _rep int, _err double, _n long")


def partial_dependence(model: PipelineModel, df: DataFrame, cols: str | Sequence[str], grid: int | None = None) -> DataFrame:
    """Mean prediction with one or two columns set to each of ``grid``
    values spanning their range (40 for one column, 25 x 25 for two).  Tree
    models are averaged leaf by leaf; for others each row fans out to that
    many copies, averaged map-side."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    grid = grid or (40 if len(cols) == 1 else 25)
    steps = [f"_g{i}" for i in range(len(cols))]
    ends = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def spread(g: DataFrame) -> DataFrame:
        for i, (c, step) in enumerate(zip(cols, steps)):
            lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
            g = g.withColumn(step, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
            g = g.withColumn(c, (F.lit(lo) + F.lit(hi - lo) * F.col(step) / (grid - 1)).cast(df.schema[c].dataType))
        return g
    forest, slots = tree_sum(model.stages[-1]), column_slots(model, cols)
    if forest and forest.splits and slots is not None:
        return _tree_dependence(model, forest, set().union(*slots.values()), df, spread(df.limit(1)), cols, steps)
    out = model.transform(spread(df)).groupBy(*steps).agg(*[F.first(c).alias(c) for c in cols], F.avg("prediction").alias("mean_pred"))
    return out.withColumnsRenamed({"_g0": "grid", "_g1": "grid2"})


def _tree_dependence(model: PipelineModel, forest: TreeSum, slots: set[int], df: DataFrame, points: DataFrame, cols: Sequence[str],
                     steps: Sequence[str]) -> DataFrame:
    """The mean predictions at the grid ``points`` (one row's copies) by
    leaves: a leaf counts, with the share of rows that meet its splits on the
    other slots, at the points that meet its splits on the grid's ``slots``.
    Each row is prepared and taken down the trees once, whatever the grid."""
    free = {s for s, (slot, _, _) in enumerate(forest.splits) if slot in slots}
    leaves = forest.leaves(free)

    def reach(batches):
        counts, n = np.zeros(len(leaves), dtype=np.int64), 0
        for t in batches:
            if not t.num_rows:
                continue
            went = forest.outcomes(matrix(t.column("_x")))
            n += t.num_rows
            not_left = ~went
            for i, (other, _, _) in enumerate(leaves):
                met = [went[s] if left else not_left[s] for s, left in other.items()]
                counts[i] += np.count_nonzero(np.logical_and.reduce(met)) if met else t.num_rows
        yield pa.RecordBatch.from_pydict({"leaf": np.arange(-1, len(leaves)), "n": np.concatenate([[n], counts])})

    ready = model.stages[0].transform(df).select(vector_to_array("features").alias("_x"))
    met = dict(ready.mapInArrow(reach, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect())  # one row per leaf
    at = model.stages[0].transform(points).select(*steps, *cols, vector_to_array("features").alias("_x")).collect()  # the grid
    went = forest.outcomes(np.array([r["_x"] for r in at]).reshape(len(at), -1)) if at else None
    mean = np.zeros(len(at))
    for i, (_, grid, value) in enumerate(leaves if at else []):
        here = [went[s] == left for s, left in grid.items()]
        mean += value * (met[i] / met[-1]) * (np.logical_and.reduce(here) if here else 1.0)
    rows = [(*[r[c] for c in [*steps, *cols]], float(m)) for r, m in zip(at, mean)]
    fields = [*[f"{s} int" for s in steps], *[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols], "mean_pred double"]
    return df.sparkSession.createDataFrame(rows, ", ".join(fields)).withColumnsRenamed({"_g0": "grid", "_g1": "grid2"})


def counterfactual(model: PipelineModel, df: DataFrame, neutral: dict, by: str, id_col: str, label: str,
                   active: Column | None = None) -> DataFrame:
    """The ``active`` rows scored as they are and with columns set to
    neutral values; per group the mean and largest change, the mean actual
    and both mean predictions."""
    rows = df if active is None else df.where(active)
    a = model.transform(rows).select(id_col, by, F.col(label).alias("_y"), F.col("prediction").alias("p0"))
    cf = rows
    for c, v in neutral.items():
        cf = cf.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
    b = model.transform(cf).select(id_col, F.col("prediction").alias("p1"))
    boost = F.col("p0") - F.col("p1")
    return a.join(b, id_col).groupBy(by).agg(F.count("*").alias("n"), F.avg(boost).alias("boost"), F.max(boost).alias("max_boost"),
                                             F.avg("_y").alias("actual_mean"), F.avg("p0").alias("pred_mean"),
                                             F.avg("p1").alias("pred_neutral_mean"))


def local_effects(model: PipelineModel, train: DataFrame, rows: DataFrame, cols: Sequence[str], id_col: str,
                  top: int = 3) -> DataFrame:
    """For each given row, replace one numeric at a time by its train
    median and report the largest prediction changes."""
    from ratecast.operators.stats import to_long
    rows = written(rows, "explained")  # the variants would each search for them again
    meds = dict.fromkeys(cols) | {r["feature"]: r["q"][0] for r in group_quantiles(to_long(train, cols), ["feature"], "value", [0.5]).collect()}
    variants = None
    for c in cols:
        v = rows.withColumn(c, F.lit(meds[c]).cast(rows.schema[c].dataType)).withColumn("feature", F.lit(c))
        variants = v if variants is None else variants.unionByName(v)
    base = model.transform(rows).select(id_col, F.col("prediction").alias("p0"))
    alt = model.transform(variants).select(id_col, "feature", F.col("prediction").alias("p1"))
    eff = alt.join(base, id_col).withColumn("contribution", F.col("p0") - F.col("p1"))
    from ratecast.operators.windows import top_n_per_group
    return top_n_per_group(eff, [id_col], [F.abs(F.col("contribution")).desc(), F.col("feature")], top, out="rank")


def ablation(train: DataFrame, test: DataFrame, label: str, configs: dict, model: str = "gbt") -> DataFrame:
    """The same model on alternative feature sets (name -> (num, bools, cats))."""
    rows = []
    for name, (num, bools, cats) in configs.items():
        prep = preprocessor(num, bools, cats).fit(train)
        m = fit_vectors(make_model(model, label), prep.transform(train))
        mae = m.transform(prep.transform(test)).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]
        rows.append((name, float(mae)))
    return train.sparkSession.createDataFrame(rows, "config string, mae double")


def time_fold_frames(df: DataFrame, order, k: int):
    from ratecast.operators.windows import time_folds
    f = written(time_folds(df, order, k), "folds")
    return [(f.where((F.col("fold") == i) & (F.col("role") == "train")).drop("fold", "role"),
             f.where((F.col("fold") == i) & (F.col("role") == "test")).drop("fold", "role")) for i in range(1, k + 1)]


def random_search(train: DataFrame, label: str, order, num, bools, cats, grid: dict, n_iter: int = 12,
                  k: int = 4, model: str = "random_forest", seed: int = 42, at_once: int = 4) -> DataFrame:
    """M9: sampled parameter sets scored by mean MAE over expanding
    time-ordered folds.  A fold's vectors are made once and held while all
    settings are fitted on them, ``at_once`` of them at a time."""
    rnd = random.Random(seed)
    combos = [{p: rnd.choice(v) for p, v in grid.items()} for _ in range(n_iter)]
    maes = [[] for _ in combos]
    err = F.avg(F.abs(F.col("prediction") - F.col(label)))
    for tr, te in time_fold_frames(train, order, k):
        prep = preprocessor(num, bools, cats).fit(tr)  # once per fold, whatever the settings
        x = sized(prep.transform(tr).select("features", label)).cache()
        y = written(prep.transform(te).select("features", label), "fold_tests")
        try:
            x.count()  # before several fits ask for it
            found = side_by_side(lambda params: make_model(model, label, **params).fit(x).transform(y).agg(err).first()[0], combos, at_once)
        finally:
            x.unpersist()
        for m, mae in zip(maes, found):
            m.append(mae)
    rows = [(str(sorted(p.items())), float(sum(m) / len(m))) for p, m in zip(combos, maes)]
    return train.sparkSession.createDataFrame(rows, "params string, cv_mae double")


def stack(train: DataFrame, test: DataFrame, label: str, id_col: str, order, num, bools, cats,
          bases: Sequence[str] = ("random_forest", "gbt"), k: int = 3) -> DataFrame:
    """M8: a linear meta-model on out-of-fold base predictions (expanding
    time folds), applied to base models refit on all of train."""
    folds = time_fold_frames(train, order, k)
    oof = None
    for tr, te in folds:
        prep = preprocessor(num, bools, cats).fit(tr)
        cols = []
        cur = prep.transform(te)
        for b, m in zip(bases, fit_all([make_model(b, label) for b in bases], prep.transform(tr))):
            cur = m.transform(cur).withColumnRenamed("prediction", f"p_{b}")
            cols.append(f"p_{b}")
        part = cur.select(id_col, label, *cols)
        oof = part if oof is None else oof.unionByName(part)
    meta_in = VectorAssembler(inputCols=[f"p_{b}" for b in bases], outputCol="meta_x")
    meta = LinearRegression(featuresCol="meta_x", labelCol=label).fit(meta_in.transform(oof))
    prep = preprocessor(num, bools, cats).fit(train)
    cur = prep.transform(test)
    for b, m in zip(bases, fit_all([make_model(b, label) for b in bases], prep.transform(train))):
        cur = m.transform(cur).withColumnRenamed("prediction", f"p_{b}")
    return meta.transform(meta_in.transform(cur)).select(id_col, label, F.col("prediction").alias("pred"))
