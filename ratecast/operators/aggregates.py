"""Profiling and error aggregates (survey A1-A45).

All of these are hash aggregates (partial aggregation map-side, then one
shuffle on the group key).  Global reference values (totals, train
means) are scalar subqueries, not unpartitioned windows over rows.
Windows that remain run over *aggregated* tables (one row per group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecast.functions.scalars import div0
from ratecast.operators.quantiles import group_quantiles, quantiles, quantiles_of_counts, with_quantiles
from ratecast.operators.windows import dedupe, last_rows, top_n_per_group
from ratecast.session import written


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A1-A3, A7 --------------------------------------------------------------------
def profile(df: DataFrame, by: Sequence, value: str, extra: Sequence[str] = (),
            pct_of_total: bool = False, median: bool = True) -> DataFrame:
    """n, mean, median of ``value`` and means of ``extra`` per group (null
    group kept); optional share of all rows (A7)."""
    keys = df.select(*by).columns
    rows = df.select(*by, F.col(value).alias("_value"), *[F.col(e).alias(f"_e_{e}") for e in extra])
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_value").alias("mean"),
                                *[F.avg(f"_e_{e}").alias(f"mean_{e}") for e in extra])
    if median:
        g = with_quantiles(g, rows, keys, "_value", {"median": 0.5})
    if pct_of_total:
        total = df.agg(F.count("*")).scalar()
        g = g.withColumn("pct", F.col("n") * 100.0 / total)
    return g


def best_worst(prof: DataFrame, label: str, metric: str = "mean") -> DataFrame:
    """A2: flag best and worst group by ``metric`` and their ratio (over
    the already aggregated profile: one row per group)."""
    best = prof.agg(F.max_by(label, F.struct(metric, label))).scalar()
    worst = prof.agg(F.min_by(label, F.struct(metric, F.col(label)))).scalar()
    ratio = prof.agg(div0(F.max(metric), F.min(metric))).scalar()
    return (prof.withColumn("is_best", F.col(label) == best).withColumn("is_worst", F.col(label) == worst)
            .withColumn("best_worst_ratio", ratio))


# A4, A8 -----------------------------------------------------------------------
def split_profile(df: DataFrame, flag, value: str) -> DataFrame:
    """A4: n, mean, median, sample std per flag value."""
    rows = df.select(_c(flag).alias("flag"), F.col(value).alias("_value"))
    g = rows.groupBy("flag").agg(F.count("*").alias("n"), F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("std"))
    return with_quantiles(g, rows, ["flag"], "_value", {"median": 0.5})


def zero_rate(df: DataFrame, by, value: str) -> DataFrame:
    """Per split, n, mean and the share of zero values."""
    return df.groupBy(_c(by).alias("split")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"),
        (F.count_if(F.col(value) == 0) / F.count("*")).alias("zero_rate"))


# A5 ---------------------------------------------------------------------------
def paired_means(df: DataFrame, entity: str, flag, value: str, min_n: int = 5) -> DataFrame:
    """Per entity: n and mean with the flag true / false; entities with at
    least ``min_n`` rows on both sides; delta = mean_true - mean_false."""
    f = _c(flag)
    g = df.groupBy(entity).agg(
        F.count_if(f).alias("n_true"), F.count_if(~f).alias("n_false"),
        F.avg(F.when(f, F.col(value))).alias("mean_true"), F.avg(F.when(~f, F.col(value))).alias("mean_false"))
    g = g.where((F.col("n_true") >= min_n) & (F.col("n_false") >= min_n))
    return g.withColumn("delta", F.col("mean_true") - F.col("mean_false"))


def paired_delta(df: DataFrame, entity: str, flag, value: str, min_n: int = 5, top: int = 20) -> DataFrame:
    """A5 table: the ``top`` entities with most flagged rows (ties by entity)."""
    return paired_means(df, entity, flag, value, min_n).orderBy(F.col("n_true").desc(), F.col(entity)).limit(top)


def paired_summary(df: DataFrame, entity: str, flag, value: str, min_n: int = 5) -> DataFrame:
    """A5 summary over *all* qualifying entities (not only the top rows)."""
    p = paired_means(df, entity, flag, value, min_n)
    median, = quantiles(p, "delta", [0.5])
    return p.agg(F.count("*").alias("n_entities"), F.avg("delta").alias("mean_delta"),
                 F.lit(median).cast("double").alias("median_delta"), F.avg((F.col("delta") > 0).cast("double")).alias("share_positive"))


# A6 ---------------------------------------------------------------------------
def share_where(df: DataFrame, by: Sequence, value: str, predicate: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"),
                               (F.avg(predicate.cast("double")) * 100).alias("pct_true"))


# A9, A42 ------------------------------------------------------------------------
def rank_entities(df: DataFrame, entity: str, value: str, min_n: int = 10, k: int = 15,
                  ascending: bool = False) -> DataFrame:
    g = df.groupBy(entity).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= min_n)
    o = F.col("mean").asc() if ascending else F.col("mean").desc()
    return g.orderBy(o, F.col(entity)).limit(k)


# A10, A11 -----------------------------------------------------------------------
def monthly_trend(df: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(F.trunc(F.to_date(date), "month").alias("month")).agg(
        F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def monthly_top(df: DataFrame, date: str, entity: str, value: str, flag: Column | None = None,
                min_n: int = 5) -> DataFrame:
    """Per month n, mean, median, the best entity with >= min_n rows
    formatted ``name (x.xx)``, and the count of flagged rows."""
    m = F.trunc(F.to_date(date), "month").alias("month")
    base = df.groupBy(m).agg(F.count("*").alias("n"), F.avg(value).alias("mean"),
                             F.count_if(flag if flag is not None else F.lit(False)).alias("n_flagged"))
    base = with_quantiles(base, df.select(m, F.col(value).alias("_value")), ["month"], "_value", {"median": 0.5})
    ent = (df.groupBy(m, F.col(entity)).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"))
           .where(F.col("_n") >= min_n))
    top = ent.groupBy("month").agg(F.max_by(F.struct(F.col(entity).alias("e"), F.col("_m").alias("m")),
                                            F.struct(F.col("_m"), F.col(entity))).alias("_t"))
    top = top.select("month", F.format_string("%s (%.2f)", F.col("_t.e").cast("string"), F.col("_t.m")).alias("top_entity"))
    return base.join(top, "month", "left")


# A13, A14 -----------------------------------------------------------------------
def heatmap(df: DataFrame, row: str, col: str, value: str, cols: Sequence) -> DataFrame:
    """Pivot of means with the column values listed up front (no
    extra job to discover them)."""
    return df.groupBy(row).pivot(col, list(cols)).agg(F.avg(value))


def heat_shade(df: DataFrame, row: str, col: str, value: str, levels: int = 4) -> DataFrame:
    """A13 shading: cell means scaled min-max over all cells into
    ``levels`` bands (0 .. levels-1)."""
    cells = df.groupBy(row, col).agg(F.avg(value).alias("mean"))
    lo = cells.agg(F.min("mean")).scalar()
    hi = cells.agg(F.max("mean")).scalar()
    scaled = div0(F.col("mean") - lo, hi - lo)
    return cells.withColumn("shade", F.least(F.floor(F.coalesce(scaled, F.lit(0.0)) * levels),
                                             F.lit(levels - 1)).cast("bigint"))


def pivot_mean_count(df: DataFrame, row: str, col: str, value: str, cols: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(col, list(cols)).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


# A15 ---------------------------------------------------------------------------
def overview(df: DataFrame, date: str, entity: str, value: str, flag: Column) -> DataFrame:
    """One row of headline scalars."""
    ent = df.groupBy(entity).agg(F.avg(value).alias("_m"))
    best = ent.agg(F.max_by(F.col(entity), F.struct("_m", F.col(entity)))).scalar()
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"),
                  F.min(F.to_date(date)).alias("first_date"), F.max(F.to_date(date)).alias("last_date"),
                  F.countDistinct(F.to_date(date)).alias("n_days"), F.avg(value).alias("mean"),
                  (F.count_if(F.col(value) == 0) / F.count("*")).alias("zero_rate"),
                  F.avg(flag.cast("double")).alias("flag_rate")).withColumn("best_entity", best)


# A16 ---------------------------------------------------------------------------
def column_profile(df: DataFrame, top: int = 3) -> DataFrame:
    """One row per column -- type, distinct, missing, numeric
    summary, and the ``top`` most frequent values (ties by value).

    One scan reduces the table, map-side combined, to (column, value,
    count); that written table yields everything else: distinct and missing
    values, weighted moments (the spread around the known mean), medians off
    running counts, and the top values.
    """
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    types = dict(df.dtypes)
    # 0.0 and -0.0 are one value
    text = {c: (F.col(c) + F.lit(0).cast(t) if t in ("double", "float") else F.col(c)).cast("string") for c, t in types.items()}
    cells = [F.struct(F.lit(c).alias("column"), text[c].alias("v"), (F.col(c).cast("double") if t in numeric else F.lit(None).cast("double")).alias("x"))
             for c, t in types.items()]
    long = df.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    counts = written(long.groupBy("column", "v", "x").agg(F.count("*").alias("n")), "profile")
    x, n = F.col("x"), F.col("n")
    sums = counts.groupBy("column").agg(
        F.count("v").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("v").isNull(), n)), F.lit(0)).alias("n_missing"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.sum(F.when(x.isNotNull(), n)).alias("_n"), div0(F.sum(x * n), F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        div0(F.sum(F.when(F.col("v") == "true", n).otherwise(0)), F.sum(F.when(F.col("v").isNotNull(), n))).alias("_true"))
    means = F.broadcast(sums.select(F.col("column").alias("_c"), F.col("mean").alias("_m")))  # one row per column
    spread = counts.where(x.isNotNull()).join(means, F.col("column") == F.col("_c")).groupBy("column").agg(F.sum(n * (x - F.col("_m")) * (x - F.col("_m"))).alias("_d2"))
    medians = quantiles_of_counts(counts.where(x.isNotNull()).select("column", F.col("x").alias("_v"), F.col("n").alias("_n")), ["column"], [0.5], out="_q")
    best = top_n_per_group(counts.where(F.col("v").isNotNull()).select("column", "v", "n"), ["column"], [F.col("n").desc(), F.col("v")], top, out="_r")
    named = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat("v", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))), lambda s: s["t"])
    tops = best.groupBy("column").agg(F.array_join(named, ", ").alias("top_values"))  # ``top`` rows a column
    kinds = F.create_map(*[F.lit(z) for p in types.items() for z in p])
    out = sums.join(spread, "column", "left").join(medians, "column", "left").join(tops, "column", "left")
    true = F.when(kinds[F.col("column")] == "boolean", F.col("_true"))
    return out.select("column", kinds[F.col("column")].alias("dtype"), F.col("n_unique").cast("bigint").alias("n_unique"), F.col("n_missing").cast("bigint").alias("n_missing"),
                      "min", F.col("_q")[0].alias("median"), "mean", F.when(F.col("_n") > 1, F.sqrt(F.col("_d2") / (F.col("_n") - 1))).alias("std"), "max",
                      true.alias("true_share"), "top_values")


# A17-A19 -----------------------------------------------------------------------
PCTS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def describe_pct(df: DataFrame, value: str, pcts: Sequence[float] = PCTS) -> DataFrame:
    """Count, mean, std, min, max and linear-interpolated percentiles
    (exact, see ``quantiles``)."""
    found = quantiles(df, value, pcts)
    return df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                  F.min(value).alias("min"), F.max(value).alias("max"),
                  *[F.lit(v).cast("double").alias(f"p{int(round(x * 100)):02d}") for x, v in zip(pcts, found)])


def extremes(df: DataFrame, value: str, id_col: str) -> DataFrame:
    """Zero count/share, rows at or above P99, the argmax row id."""
    p99 = F.lit(quantiles(df, value, [0.99])[0]).cast("double")
    return df.agg(F.count_if(F.col(value) == 0).cast("bigint").alias("n_zero"),
                  (F.count_if(F.col(value) == 0) / F.count("*")).alias("zero_share"),
                  F.count_if(F.col(value) >= p99).cast("bigint").alias("n_ge_p99"),
                  F.max_by(id_col, F.struct(F.col(value), F.col(id_col))).alias("argmax_id"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty
    bins kept with 0."""
    lo = df.agg(F.min(value)).scalar()
    hi = df.agg(F.max(value)).scalar()
    width = (hi - lo) / bins
    b = F.least(F.floor(div0(F.col(value) - lo, width)), F.lit(bins - 1)).cast("bigint")
    counts = df.where(F.col(value).isNotNull()).groupBy(F.coalesce(b, F.lit(0).cast("bigint")).alias("bin")).count()
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return (spine.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("n")))


def binned(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str] | None = None,
           right: bool = False, aggs: dict[str, Column] | None = None) -> DataFrame:
    """Explicit edges, ``[a, b)`` (or ``(a, b]`` with
    ``right``); a last edge of None opens the last bin upwards; values
    outside all bins are dropped."""
    v = F.col(value)

    def inside(a, b):
        above = v > a if right else v >= a
        return above if b is None else above & (v <= b if right else v < b)
    expr = order = None
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1]
        lab = labels[i] if labels else f"{a}+" if b is None else f"{a}-{b}"
        expr = F.when(inside(a, b), F.lit(lab)) if expr is None else expr.when(inside(a, b), F.lit(lab))
    for i in range(len(edges) - 1):
        cond = inside(edges[i], edges[i + 1])
        order = F.when(cond, F.lit(i)) if order is None else order.when(cond, F.lit(i))
    base = [F.count("*").alias("n")] + [e.alias(k) for k, e in (aggs or {}).items()]
    return (df.withColumn("bin", expr).withColumn("bin_order", order.cast("bigint")).where(F.col("bin").isNotNull())
            .groupBy("bin", "bin_order").agg(*base))


# A20 ---------------------------------------------------------------------------
def pearson_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairwise correlations in one aggregate pass, returned long."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    st = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return one.selectExpr(f"stack({len(pairs)}, {st}) AS (a, b, r)")


# A22-A24 -----------------------------------------------------------------------
def metrics(df: DataFrame, actual: str, pred: str, by: Sequence = ()) -> DataFrame:
    """N, MAE, RMSE, R2 (null-masked: rows with a null on either side
    are skipped)."""
    x = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    e = F.col(pred) - F.col(actual)
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"),
                           F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_ssr"),
                           F.var_pop(actual).alias("_vp"))
    return g.withColumn("r2", 1 - div0(F.col("_ssr"), F.col("_vp") * F.col("n"))).drop("_ssr", "_vp")


def error_summary(df: DataFrame, actual: str, pred: str, tol: Sequence[float] = (0.2, 0.5)) -> DataFrame:
    """Bias (pred - actual), share within each tolerance, error
    P10/P50/P90."""
    e = F.col(pred) - F.col(actual)
    p10, p50, p90 = (F.lit(v).cast("double") for v in quantiles(df, e, [0.1, 0.5, 0.9]))
    return df.agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"),
                  *[F.avg((F.abs(e) <= t).cast("double")).alias(f"within_{str(t).replace('.', '_')}") for t in tol],
                  p10.alias("err_p10"), p50.alias("err_p50"), p90.alias("err_p90"))


def segment_errors(df: DataFrame, actual: str, pred: str, by, min_n: int = 0, sign: int = -1) -> DataFrame:
    """Per segment n, MAE, actual mean, pred mean and bias
    (``sign=-1``: actual - pred, ``sign=1``: pred - actual; T22)."""
    err = (F.col(actual) - F.col(pred)) if sign < 0 else (F.col(pred) - F.col(actual))
    g = df.groupBy(_c(by).alias("segment") if not isinstance(by, str) else F.col(by)).agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(actual).alias("actual_mean"),
        F.avg(pred).alias("pred_mean"), F.avg(err).alias("bias"))
    return g.where(F.col("n") >= min_n)


# A25-A28 -----------------------------------------------------------------------
def to_long(df: DataFrame, ids: Sequence[str], preds: dict[str, str]) -> DataFrame:
    """Wide prediction columns -> (model, pred) rows."""
    st = ", ".join(f"'{m}', `{c}`" for m, c in preds.items())
    return df.selectExpr(*[f"`{i}`" for i in ids], f"stack({len(preds)}, {st}) AS (model, pred)")


def model_matrix(long: DataFrame, actual: str, by: str, models: Sequence[str]) -> DataFrame:
    """Segment x model MAE matrix."""
    return (long.groupBy(by).pivot("model", list(models))
            .agg(F.avg(F.abs(F.col("pred") - F.col(actual)))))


def leaderboard(long: DataFrame, actual: str, baseline: str) -> DataFrame:
    """Per model MAE/RMSE/R2, ranked by MAE, with improvement % over
    the baseline model's MAE."""
    m = metrics(long, actual, "pred", by=["model"])
    base = m.where(F.col("model") == baseline).agg(F.first("mae")).scalar()
    w = Window.orderBy(F.col("mae"), F.col("model"))  # one row per model
    return (m.withColumn("improvement_pct", (base - F.col("mae")) * 100.0 / base)
            .withColumn("rank", F.row_number().over(w).cast("bigint")))


def family_summary(board: DataFrame, families: dict[str, str]) -> DataFrame:
    """Per family count, best/worst MAE, best R2, leading model."""
    fam = F.create_map(*[x for kv in families.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    b = board.withColumn("family", F.coalesce(F.element_at(fam, F.col("model")), F.lit("other")))
    return b.groupBy("family").agg(F.count("*").alias("n_models"), F.min("mae").alias("best_mae"),
                                   F.max("mae").alias("worst_mae"), F.max("r2").alias("best_r2"),
                                   F.min_by("model", F.struct("mae", "model")).alias("leader"))


def difficulty(long: DataFrame, entity: str, actual: str, min_n: int = 5) -> DataFrame:
    """Per entity the MAE of every model, then across models: mean,
    min, max, population std and their number; entities with >= min_n rows."""
    per = long.groupBy(entity, "model").agg(F.count("*").alias("_n"),
                                            F.avg(F.abs(F.col("pred") - F.col(actual))).alias("_mae"))
    return (per.groupBy(entity).agg(F.max("_n").alias("n"), F.avg("_mae").alias("mae_mean"),
                                    F.min("_mae").alias("mae_min"), F.max("_mae").alias("mae_max"),
                                    F.stddev_pop("_mae").alias("mae_std"), F.count("*").alias("n_models"))
            .where(F.col("n") >= min_n))


def hardest(table: DataFrame, entity: str, k: int = 10) -> DataFrame:
    """The ``k`` entities whose best model's MAE is highest (ties by entity)."""
    return table.orderBy(F.col("mae_min").desc(), F.col(entity)).limit(k)


def most_divergent(table: DataFrame, entity: str, k: int = 10) -> DataFrame:
    """The ``k`` entities on which the models differ most (ties by entity)."""
    return table.orderBy(F.col("mae_std").desc(), F.col(entity)).limit(k)


# A29, A30 ---------------------------------------------------------------------
def daily(df: DataFrame, date: str, means: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(F.to_date(date).alias("ds")).agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in means],
        *[F.max(F.col(f).cast("int")).alias(f) for f in flags])


def weekly_errors(df: DataFrame, date: str, actual: str, pred: str) -> DataFrame:
    """Monday-start weeks."""
    e = F.col(pred) - F.col(actual)
    return df.groupBy(F.to_date(F.date_trunc("week", F.to_date(date))).alias("week")).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


# A32 ---------------------------------------------------------------------------
def entity_profile(df: DataFrame, entity: str, actual: str, pred: str, min_n: int = 5) -> DataFrame:
    e = F.abs(F.col(pred) - F.col(actual))
    g = df.groupBy(entity).agg(F.count("*").alias("n"), F.avg(actual).alias("mean"),
                               F.stddev_samp(actual).alias("std"), F.avg(e).alias("mae"))
    return (g.where(F.col("n") >= min_n)
            .withColumn("learnability", F.col("std") / F.greatest(F.col("mae"), F.lit(0.01)))
            .withColumn("rel_mae", F.col("mae") / F.greatest(F.col("mean"), F.lit(0.05))))


# A34 ---------------------------------------------------------------------------
def bias_cells(df: DataFrame, keys: Sequence[str], actual: str, pred: str, min_n: int = 30,
               min_bias: float = 0.10, cap: float = 0.30) -> DataFrame:
    """Cells with >= min_n rows and |bias| >= min_bias; correction = bias
    (actual - pred) clipped to +-cap."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(actual) - F.col(pred)).alias("bias"))
    g = g.where((F.col("n") >= min_n) & (F.abs(F.col("bias")) >= min_bias))
    return g.withColumn("correction", F.greatest(F.least(F.col("bias"), F.lit(cap)), F.lit(-cap)))


# A35 ---------------------------------------------------------------------------
def cluster_summary(df: DataFrame, cluster: str, shares: dict[str, Column], modes: Sequence[str],
                    means: dict[str, Column] | None = None) -> DataFrame:
    """Per cluster n, means (error, bias, actual, ...), share of rows meeting
    each predicate, and the most frequent value of each ``modes`` column
    (ties: smallest value)."""
    g = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{k}") for k, m in (means or {}).items()],
                                *[F.avg(p.cast("double")).alias(f"share_{k}") for k, p in shares.items()])
    for m in modes:
        vc = df.groupBy(cluster, m).agg(F.count("*").alias("_c"))
        mx = vc.groupBy(cluster).agg(F.max("_c").alias("_mx"))
        # deterministic tie rule: among the values with the top count, the smallest
        tie = (vc.join(mx, cluster).where(F.col("_c") == F.col("_mx"))
               .groupBy(cluster).agg(F.min(m).alias(f"mode_{m}")))
        g = g.join(tie, cluster, "left")
    return g


# A37 ---------------------------------------------------------------------------
def coverage(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    a = F.col(actual)
    return df.agg(F.count("*").alias("n"),
                  F.avg(a.between(F.col(low), F.col(high)).cast("double")).alias("coverage"),
                  F.avg(F.col(high) - F.col(low)).alias("mean_width"),
                  F.avg((a < F.col(low)).cast("double")).alias("below"),
                  F.avg((a > F.col(high)).cast("double")).alias("above"))


def coverage_by_width(df: DataFrame, actual: str, low: str, high: str, bins: int = 5) -> DataFrame:
    """Equal-width bins of the interval width, right-closed, lowest
    edge widened by 0.1% of the range."""
    w = F.col(high) - F.col(low)
    lo = df.agg(F.min(w)).scalar()
    hi = df.agg(F.max(w)).scalar()
    step = (hi - lo) / bins
    b = F.when(w <= lo + step, 0)
    for i in range(1, bins):
        b = b.when(w <= lo + step * (i + 1), i)
    b = b.otherwise(bins - 1)
    return df.groupBy(b.cast("bigint").alias("width_bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double")).alias("coverage"),
        F.avg(w).alias("mean_width"))


# A38-A41, A44, A45 -----------------------------------------------------------------
def model_spread(df: DataFrame, preds: Sequence[str], out: str = "spread") -> DataFrame:
    """Per row, the sample std across model predictions (ddof 1)."""
    arr = F.array(*[F.col(p) for p in preds])
    k = len(preds)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / k
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return df.withColumn(out, F.sqrt(ss / (k - 1)))


def status_bias(df: DataFrame, by: str, actual: str, pred: str) -> DataFrame:
    """Per category n, bias and MAE of one model and the actual mean."""
    e = F.col(pred) - F.col(actual)
    return df.groupBy(by).agg(F.count(actual).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"),
                              F.avg(actual).alias("actual_mean"))


def drift_pct(df: DataFrame, split: str, value: str, train: str = "train", test: str = "test") -> DataFrame:
    """(test mean - train mean) / train mean * 100, per value."""
    g = df.agg(F.avg(F.when(F.col(split) == train, F.col(value))).alias("train_mean"),
               F.avg(F.when(F.col(split) == test, F.col(value))).alias("test_mean"))
    return g.withColumn("drift_pct", (F.col("test_mean") - F.col("train_mean")) * 100.0 / F.col("train_mean"))


def catalog(df: DataFrame, key: str, date: str, first: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key count, first and last date, and the first-row values
    of ``first`` (earliest by ``order``)."""
    totals = df.groupBy(key).agg(F.count("*").alias("n"), F.min(F.to_date(date)).alias("first_date"), F.max(F.to_date(date)).alias("last_date"))
    rows = dedupe(df.select(key, *dict.fromkeys([*first, *order])), [key], order, keep="first")
    rows = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"first_{c}") for c in first])
    return totals.join(rows, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def entity_mean(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """Per entity, the count and mean of its non-null values, of the
    last ``limit`` by ``order`` or of all."""
    rows = df.where(F.col(value).isNotNull())
    if limit is not None:
        rows = last_rows(rows, key, order, limit)
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def usage(df: DataFrame, ts: str, kind: str, as_of, days: int = 7) -> DataFrame:
    """Total rows, rows in the last ``days`` days before ``as_of``,
    and per-kind counts (one row per kind)."""
    recent = F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")
    g = df.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(recent).alias("n_recent"))
    total = df.agg(F.count("*")).scalar()
    total_recent = df.agg(F.count_if(recent)).scalar()
    return g.withColumn("total", total).withColumn("total_recent", total_recent)


def sign_counts(df: DataFrame, err: str, category: str, id_col: str, n: int = 5) -> DataFrame:
    """under/over counts and per-category counts as ``cat:n`` text, of
    the ``n`` rows with the largest absolute error (ties by id)."""
    df = df.orderBy(F.abs(F.col(err)).desc(), F.col(id_col)).limit(n)
    per = df.groupBy(category).agg(F.count("*").alias("_n"))
    cats = per.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.col(category).cast("string"), F.lit(":"), F.col("_n").cast("string")))), ",")).scalar()
    return df.agg(F.count_if(F.col(err) < 0).cast("bigint").alias("n_under"),
                  F.count_if(F.col(err) > 0).cast("bigint").alias("n_over")).withColumn("categories", cats)


def metric_delta(a: DataFrame, b: DataFrame, key: str = "model", metric: str = "mae") -> DataFrame:
    """Version-to-version change in % per model."""
    j = a.select(key, F.col(metric).alias("before")).join(b.select(key, F.col(metric).alias("after")), key)
    return j.withColumn("delta_pct", (F.col("after") - F.col("before")) * 100.0 / F.col("before"))
