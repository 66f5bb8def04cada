"""Distribution statistics as Spark jobs (survey A21, A36, M21-M24, M28, M29).

Rank-based statistics (KS, Spearman, Q-Q) need positions in a sorted
order.  They never sort raw rows in one task: values are first reduced
to (feature, value) counts, and prefix counts use the two-level scheme of
``windows.running_totals`` over the pieces of ``windows.counted_pieces``,
so a feature's values are spread over as many tasks as their number asks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecast.functions.scalars import div0
from ratecast.operators.quantiles import group_quantiles, quantiles
from ratecast.operators.topk import hash_words
from ratecast.operators.windows import counted_pieces, global_index, running_totals


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    st = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(*[f"`{i}`" for i in ids], f"stack({len(cols)}, {st}) AS (feature, value)")


# M22 ---------------------------------------------------------------------------
def psi(train: DataFrame, test: DataFrame, cols: Sequence[str], bins: int = 10, min_rows: int = 50) -> DataFrame:
    """Population stability per feature: edges = distinct linear
    quantiles of train at 0, 1/bins, ..., 1; numpy-style histogram (last
    bin closed, values outside the edges dropped); proportions + 1e-6;
    0.0 when fewer than 3 edges; features with < min_rows non-null rows
    on either side are skipped (T27)."""
    qs = [i / bins for i in range(bins + 1)]
    a = to_long(train, cols).where(F.col("value").isNotNull()).withColumn("side", F.lit("a"))
    b = to_long(test, cols).where(F.col("value").isNotNull()).withColumn("side", F.lit("b"))
    edges = group_quantiles(a, ["feature"], "value", qs, out="edges").withColumn("edges", F.array_distinct(F.array_sort("edges")))
    sizes = (a.unionByName(b).groupBy("feature")
             .agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
             .where((F.col("na") >= min_rows) & (F.col("nb") >= min_rows)))
    e = edges.join(sizes, "feature")
    x = a.unionByName(b).join(F.broadcast(e.select("feature", "edges")), "feature")
    k = F.size("edges") - 1
    lo, hi = F.element_at("edges", 1), F.element_at("edges", -1)
    idx = F.least(F.size(F.filter("edges", lambda z: z <= F.col("value"))) - 1, k - 1)
    x = x.where((F.col("value") >= lo) & (F.col("value") <= hi)).withColumn("bin", idx)
    counts = x.groupBy("feature", "bin").agg(F.count_if(F.col("side") == "a").alias("ca"),
                                             F.count_if(F.col("side") == "b").alias("cb"))
    spine = e.where(F.size("edges") >= 3).select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2))
                                                  .alias("bin"), "edges")
    full = spine.join(counts, ["feature", "bin"], "left").fillna(0, ["ca", "cb"])
    w = Window.partitionBy("feature")  # one row per (feature, bin): bounded
    full = (full.withColumn("pa", F.col("ca") / F.sum("ca").over(w) + 1e-6)
            .withColumn("pb", F.col("cb") / F.sum("cb").over(w) + 1e-6))
    term = (F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))
    res = full.groupBy("feature").agg(F.sum(term).alias("_psi"), F.first(F.size("edges")).alias("_ne"))
    res = res.select("feature", F.when(F.col("_ne") < 3, F.lit(0.0)).otherwise(F.col("_psi")).alias("psi"))
    # features with < 3 edges have no bins at all: add them back with 0.0
    few = e.where(F.size("edges") < 3).select("feature", F.lit(0.0).alias("psi"))
    return res.unionByName(few).groupBy("feature").agg(F.max("psi").alias("psi"))


# M23 ---------------------------------------------------------------------------
def kolmogorov_sf(z: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided Kolmogorov survival function
    2 * sum_k (-1)^(k-1) exp(-2 k^2 z^2), clipped to [0, 1]."""
    s = None
    for k in range(1, terms + 1):
        t = F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * z * z)
        s = t if s is None else s + t
    return F.when(z <= 0, F.lit(1.0)).otherwise(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0)))


def ks(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two-sample KS statistic per feature (max |F_a - F_b| over all
    values) with the asymptotic p-value."""
    a = to_long(train, cols).where(F.col("value").isNotNull())
    b = to_long(test, cols).where(F.col("value").isNotNull())
    cnt = (a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
           .unionByName(b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
           .groupBy("feature", "value").agg(F.sum("_a").cast("double").alias("na"), F.sum("_b").cast("double").alias("nb")))
    cnt, chunk = counted_pieces(cnt, ["feature", "value"])
    cum = running_totals(cnt, ["feature"], ["value"], sums={"ca": F.col("na"), "cb": F.col("nb")},
                         chunk=chunk, inclusive=True, rows_per_piece=None)
    tot = cnt.groupBy("feature").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    j = cum.join(tot, "feature")
    d = F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))
    g = j.groupBy("feature").agg(F.max(d).alias("ks_stat"), F.first("ta").alias("ta"), F.first("tb").alias("tb"))
    en = F.sqrt(F.col("ta") * F.col("tb") / (F.col("ta") + F.col("tb")))
    return g.select("feature", "ks_stat", kolmogorov_sf(en * F.col("ks_stat")).alias("ks_p"))


# A21 ---------------------------------------------------------------------------
def value_ranks(long: DataFrame) -> DataFrame:
    """(feature, value, rank) of a long table: ties share the mean of their
    positions; computed on per-value counts with two-level prefix sums."""
    per = (long.where(F.col("value").isNotNull()).groupBy("feature", "value")
           .agg(F.count("*").cast("double").alias("n")))
    per, chunk = counted_pieces(per, ["feature", "value"])
    cum = running_totals(per, ["feature"], ["value"], sums={"_before": F.col("n")}, chunk=chunk, rows_per_piece=None)
    return cum.select("feature", "value", (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def _ranks_of(ranks: DataFrame, feature: str, col: str, out: str) -> DataFrame:
    return ranks.where(F.col("feature") == feature).select(F.col("value").alias(col), F.col("rank").alias(out))


def spearman_vs(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Spearman correlation of each column with ``target`` (ranks over the
    rows where both are non-null).  All columns are ranked in one long table.
    When no involved column has nulls every pair ranks the same rows, so
    each column -- the target included -- is ranked once."""
    nulls = df.agg(F.count_if(F.greatest(*[F.col(c).isNull() for c in [*cols, target]]))).first()[0]
    base = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*cols, target])])
    if nulls == 0:
        ranks = value_ranks(to_long(base, base.columns))
        x = base.join(_ranks_of(ranks, target, target, "_rt"), target, "left")
        for i, c in enumerate(cols):
            x = x.join(_ranks_of(ranks, c, c, f"_r{i}"), c, "left")
        one = x.agg(*[F.corr(f"_r{i}", "_rt").alias(f"_s{i}") for i in range(len(cols))])
        st = ", ".join(f"'{c}', `_s{i}`" for i, c in enumerate(cols))
        return one.selectExpr(f"stack({len(cols)}, {st}) AS (feature, spearman)")
    # a pair's two columns are null together, so each pair ranks its own rows
    both = {c: F.col(c).isNotNull() & F.col(target).isNotNull() for c in cols}
    wide = base.select(*[F.when(both[c], F.col(c)).alias(f"_x{i}") for i, c in enumerate(cols)],
                       *[F.when(both[c], F.col(target)).alias(f"_y{i}") for i, c in enumerate(cols)])
    ranks = value_ranks(to_long(wide, wide.columns))
    out = None
    for i, c in enumerate(cols):
        x = wide.select(f"_x{i}", f"_y{i}").where(F.col(f"_x{i}").isNotNull())
        x = (x.join(_ranks_of(ranks, f"_x{i}", f"_x{i}", "_rc"), f"_x{i}", "left")
             .join(_ranks_of(ranks, f"_y{i}", f"_y{i}", "_rt"), f"_y{i}", "left"))
        r = x.agg(F.corr("_rc", "_rt").alias("spearman")).withColumn("feature", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return out.select("feature", "spearman")


# M21 ---------------------------------------------------------------------------
COUNTER_STEP = 2654435769  # an odd step, so that replicates' counters differ
# of a 32-bit mix in plain arithmetic: every product stays below 2^62, so any SQL engine can repeat it
HASH_MULTIPLIERS = (668265261, 739982445, 695872825)


def poisson1_thresholds(kmax: int = 12) -> list[float]:
    """CDF of Poisson(1) at 0..kmax (built from the formula)."""
    out, s = [], 0.0
    for k in range(kmax + 1):
        s += math.exp(-1.0) / math.factorial(k)
        out.append(s)
    return out


def _mix32_np(x: np.ndarray, seed: int) -> np.ndarray:
    m0, m1, m2 = (np.uint64(m) for m in HASH_MULTIPLIERS)
    low = np.uint64(0xFFFFFFFF)
    h = (x * m0 + np.uint64(seed)) & low
    h = ((h ^ (h >> np.uint64(15))) * m1) & low
    h = ((h ^ (h >> np.uint64(13))) * m2) & low
    return h ^ (h >> np.uint64(16))


def replicate_weights(first: np.ndarray, second: np.ndarray, b: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of rows (their two hash words) in replicates 1..b:
    the replicate is a counter added to the first word."""
    rep = np.arange(1, b + 1, dtype=np.uint64) * np.uint64(COUNTER_STEP)
    u = _mix32_np(_mix32_np((first[:, None] + rep) & np.uint64(0xFFFFFFFF), seed) ^ second[:, None], seed + 1)
    return np.searchsorted(np.array(poisson1_thresholds()), u / 4294967296.0, side="right")


def bootstrap_mae(df: DataFrame, err: str, id_col: str, b: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap CI of the MAE with Poisson(1) replicate weights drawn
    from a seeded hash of (64-bit row id, replicate): no resampling shuffle
    and no copies of rows.  A task adds its rows into one vector of
    replicate sums, and only these vectors meet.  A null id counts as 0."""
    first, second = hash_words(F.coalesce(F.col(id_col), F.lit(0)), seed)
    rows = df.select(first.alias("a"), second.alias("b"), F.abs(F.col(err)).cast("double").alias("e"))

    def run(batches):
        weight, error = np.zeros(b), np.zeros(b)
        for batch in batches:
            first, second, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(0, len(e), 512):
                w = replicate_weights(first[i:i + 512].astype(np.uint64), second[i:i + 512].astype(np.uint64), b, seed).astype(float)
                weight += w.sum(axis=0)
                error += np.nan_to_num(e[i:i + 512], nan=0.0) @ w
        yield pa.RecordBatch.from_arrays([pa.array([weight.tolist()]), pa.array([error.tolist()])], names=["w", "e"])

    vectors = rows.mapInArrow(run, "w array<double>, e array<double>")
    pairs = vectors.select(F.posexplode(F.arrays_zip("w", "e")).alias("rep", "s"))
    reps = pairs.groupBy("rep").agg(div0(F.sum("s.e"), F.sum("s.w")).alias("mae"))
    point = df.agg(F.avg(F.abs(F.col(err)))).scalar()
    return reps.agg(F.avg("mae").alias("boot_mean"), F.percentile("mae", 0.025).alias("ci_low"),
                    F.percentile("mae", 0.975).alias("ci_high"), F.stddev_pop("mae").alias("std")) \
        .withColumn("point", point)


# M24 ---------------------------------------------------------------------------
# Inverse normal CDF by a published rational approximation (Acklam);
# coefficients are fixed values of that method.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
      -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
      -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
      4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
_PLOW = 0.02425


def _poly(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _poly_sql(coefs, x):
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def norm_ppf_sql(p: str) -> str:
    """The same approximation as SQL text (for the DuckDB oracle)."""
    ql, qh, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    r = f"({q} * {q})"
    lo = f"{_poly_sql(_C, ql)} / ({_poly_sql(_D, ql)} * {ql} + 1)"
    mid = f"{_poly_sql(_A, r)} * {q} / ({_poly_sql(_B, r)} * {r} + 1)"
    hi = f"-{_poly_sql(_C, qh)} / ({_poly_sql(_D, qh)} * {qh} + 1)"
    return f"CASE WHEN {p} < {_PLOW} THEN {lo} WHEN {p} <= {1 - _PLOW} THEN {mid} ELSE {hi} END"


def norm_ppf(p: Column) -> Column:
    q_lo = F.sqrt(-2 * F.ln(p))
    lo = _poly(_C, q_lo) / (_poly(_D, q_lo) * q_lo + 1)
    q = p - 0.5
    r = q * q
    mid = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    q_hi = F.sqrt(-2 * F.ln(1 - p))
    hi = -_poly(_C, q_hi) / (_poly(_D, q_hi) * q_hi + 1)
    return F.when(p < _PLOW, lo).when(p <= 1 - _PLOW, mid).otherwise(hi)


def qq_points(df: DataFrame, value: str, tiebreak: str) -> DataFrame:
    """Normal Q-Q pairs: sorted sample vs normal quantiles at Filliben
    plotting positions."""
    x = df.where(F.col(value).isNotNull()).select(value, tiebreak)
    n = x.agg(F.count("*")).scalar()
    r = global_index(x, [value, tiebreak], out="i")
    # n and the plotting position become columns first, so the polynomial
    # below references a column instead of repeating the subquery
    r = r.withColumn("_n", n)
    m = (F.col("i") - 0.3175) / (F.col("_n") + 0.365)
    m = (F.when(F.col("i") == 1, 1 - F.pow(F.lit(0.5), 1 / F.col("_n")))
         .when(F.col("i") == F.col("_n"), F.pow(F.lit(0.5), 1 / F.col("_n"))).otherwise(m))
    r = r.withColumn("_p", m)
    return r.select(F.col("i").cast("bigint").alias("i"), F.col(value).alias("sample"),
                    norm_ppf(F.col("_p")).alias("theoretical"))


# A36 ---------------------------------------------------------------------------
def calibration(df: DataFrame, actual: str, pred: str, q: int = 15) -> DataFrame:
    """Bins at distinct linear quantiles of the prediction (right-closed,
    lowest edge included); per bin n, mean pred, mean actual, gap, and
    the bin with the largest |gap| flagged."""
    qs = [i / q for i in range(q + 1)]
    # q+1 edge values: a bounded parameter, fetched once and inlined
    vals = sorted({v for v in quantiles(df, pred, qs) if v is not None})
    edges = F.array(*[F.lit(v) for v in vals]).cast("array<double>")
    b = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(pred))), F.lit(1))
    g = df.where(F.col(pred).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(pred).alias("mean_pred"), F.avg(actual).alias("mean_actual"))
    g = g.withColumn("gap", F.col("mean_actual") - F.col("mean_pred"))
    worst = g.agg(F.max_by("bin", F.abs(F.col("gap")))).scalar()
    return g.withColumn("is_max_gap", F.col("bin") == worst)


# M28 ---------------------------------------------------------------------------
def decompose_weekly(daily: DataFrame, date: str, value: str) -> DataFrame:
    """Weekly decomposition of a gap-free daily series: trend = centred
    7-day mean (null at the ends), seasonal = weekday mean of the
    detrended series centred to zero mean, residual = rest.  The series
    has one row per day, so its windows are bounded by the calendar."""
    w = Window.orderBy(date).rowsBetween(-3, 3)
    x = (daily.withColumn("_c", F.count(value).over(w))
         .withColumn("trend", F.when(F.col("_c") == 7, F.avg(value).over(w)))
         .withColumn("_dow", F.dayofweek(date)))
    det = F.col(value) - F.col("trend")
    by_dow = x.groupBy("_dow").agg(F.avg(det).alias("_s"))
    centre = by_dow.agg(F.avg("_s")).scalar()
    x = x.join(by_dow, "_dow", "left").withColumn("seasonal", F.col("_s") - centre)
    x = x.withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
    return x.select(date, F.col(value).alias("observed"), "trend", "seasonal", "resid")


def decomposition_strength(dec: DataFrame, date: str) -> DataFrame:
    ok = dec.where(F.col("resid").isNotNull())
    amp = dec.groupBy(F.dayofweek(date).alias("_d")).agg(F.avg("seasonal").alias("_s"))
    amplitude = amp.agg(F.max("_s") - F.min("_s")).scalar()
    return ok.agg((1 - F.var_samp("resid") / F.var_samp(F.col("trend") + F.col("resid"))).alias("trend_strength"),
                  (1 - F.var_samp("resid") / F.var_samp(F.col("seasonal") + F.col("resid"))).alias("seasonal_strength")
                  ).withColumn("weekday_amplitude", amplitude)
