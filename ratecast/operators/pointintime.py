"""Point-in-time features for forecast requests (survey W12-W14).

A request (key, target date) needs aggregates of history strictly before
its date.  Instead of joining every request to every earlier history row,
history is reduced to per-(key, day) totals and requests to their distinct
(key, day); both go through one window per key over days, whose range
frames give the look-back and the whole past at once.  The requests then
join that as-of table by equality.  Windows see at most one row per key and
day and one per key and asked day, so a hot key costs its days, never its
rows or requests, and needs no salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecast.functions.scalars import div0


def _match(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join by equality of ``names``, nulls included; the right side's own columns are added."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in names], *[c for c in right.columns if c not in names])
    cond = F.lit(True)
    for c in names:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, cond, how).drop(*[f"_r_{c}" for c in names])


def daily_totals(history: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Per (keys, day): sum, sum of squares and count of ``value``."""
    return history.groupBy(*keys, F.to_date(date).alias("_d")).agg(
        F.sum(F.col(value).cast("double")).alias("_s"), F.sum((F.col(value) * F.col(value)).cast("double")).alias("_q"), F.count(value).alias("_n"))


def asof_totals(asks: DataFrame, totals: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    """(keys, ``_t``, rec_s, rec_q, rec_n, all_s, all_q, all_n) per row of
    ``asks``, which are distinct (keys, ``_t``): the totals of the ``days``
    days before ``_t`` and of all days before it; zeros where there are none."""
    keys = list(keys)
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    known = totals.select(*keys, day("_d").alias("_day"), F.lit(None).cast("date").alias("_t"), F.lit(False).alias("_ask"), "_s", "_q", "_n")
    asked = asks.select(*keys, day("_t").alias("_day"), F.col("_t"), F.lit(True).alias("_ask"),
                        F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_q"), F.lit(None).cast("bigint").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_day")  # one row per day and asked day of a key
    frames = {"rec": w.rangeBetween(-days, -1), "all": w.rangeBetween(Window.unboundedPreceding, -1)}
    zero = {"s": 0.0, "q": 0.0, "n": 0}
    u = known.unionByName(asked).select(*keys, "_t", "_ask", *[F.sum(f"_{c}").over(f).alias(f"{name}_{c}") for name, f in frames.items() for c in zero])
    return u.where("_ask").select(*keys, "_t", *[F.coalesce(f"{name}_{c}", F.lit(z)).alias(f"{name}_{c}") for name in frames for c, z in zero.items()])


def point_in_time(requests: DataFrame, history: DataFrame, keysets: dict[str, tuple[Sequence[str], Sequence[str]]],
                  target: str, date: str, value: str, days: int = 90, min_rows: int = 200,
                  values: dict[str, str] | None = None) -> DataFrame:
    """Per request and keyset, the mean and count of history in the
    last ``days`` days before the target (all earlier history when that
    window holds fewer than ``min_rows`` rows overall); an empty key falls
    back to the overall mean of the chosen window.  ``values`` names the
    keysets that take another column than ``value``.  Keysets on the same
    request columns join the requests as one table."""
    r = requests.withColumn("_t", F.to_date(target))
    recent = F.col("rec_n") >= min_rows
    pick = lambda c: F.when(F.col("_recent"), F.col(f"rec_{c}")).otherwise(F.col(f"all_{c}"))

    def overall(v):  # one row per target date
        b = asof_totals(r.select("_t").distinct(), daily_totals(history, [], date, v), [], days).withColumn("_recent", recent)
        return b.select("_t", "_recent", div0(pick("s"), pick("n")).alias("_mean"))
    of = {name: (values or {}).get(name, value) for name in keysets}
    base = {v: overall(v) for v in dict.fromkeys(of.values())}
    tables = {}
    for name, (rk, hk) in keysets.items():
        totals = daily_totals(history, hk, date, of[name]).withColumnsRenamed({h: k for h, k in zip(hk, rk) if h != k})
        found = _match(asof_totals(r.select(*rk, "_t").distinct(), totals, rk, days), base[of[name]], ["_t"])
        n = pick("n").cast("bigint")
        found = found.select(*rk, "_t", n.alias(f"lag_{name}_n"), F.when(n > 0, div0(pick("s"), n)).otherwise(F.col("_mean")).alias(f"lag_{name}_mean"))
        at = tuple(rk)
        tables[at] = _match(tables[at], found, [*rk, "_t"]) if at in tables else found
    out = r.drop(*[f"lag_{name}_{c}" for name in keysets for c in ("n", "mean")])
    for rk, found in tables.items():
        out = _match(out, found, [*rk, "_t"])
    return out.drop("_t")


def series_state(history: DataFrame, key: Sequence[str], date: str, value: str, order: Sequence[str],
                 span: int = 4) -> DataFrame:
    """W13 helper: per history row, the serving state *after* that row:
    last two values (a series of one row gives it twice; nulls are left out), EMA (adjust=False) and mean of the last four, row
    count and first date of the series."""
    from ratecast.operators.windows import bounded_window, ema, running_totals
    history = history.where(F.col(value).isNotNull())

    def cols(w):
        return {"s_lag_2": F.coalesce(F.lag(value, 1).over(w), F.col(value)), "s_roll4": F.avg(value).over(w.rowsBetween(-3, 0))}
    day = F.to_date(date)
    st = bounded_window(history, key, order, 3, cols)
    st = ema(st, key, value, order, span=span, out="s_ema", inclusive=True)
    st = running_totals(st, key, order, count_out="s_n", inclusive=True)
    first = history.groupBy(*key).agg(F.min(day).alias("s_first"))
    return _match(st, first, key).select(*key, day.alias("_d"), *[F.col(c) for c in order if c not in key],
                                         F.col(value).alias("s_lag_1"), "s_lag_2", "s_ema", "s_roll4", "s_n", "s_first")


def series_features(requests: DataFrame, history: DataFrame, key: Sequence[str], target: str, date: str,
                    value: str, order: Sequence[str], cold_default: float | Column | None = None) -> DataFrame:
    """The state of the request's own series as of the day before the
    target (latest history row dated before it); cold start -> default."""
    key = list(key)
    cols = ["s_lag_1", "s_lag_2", "s_ema", "s_roll4", "s_n", "s_first"]
    # only the last state of each (key, day) can answer: one row per day
    last = F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order if c not in key]))
    st = series_state(history, key, date, value, order).groupBy(*key, "_d").agg(last.alias("_st"))
    req = requests.withColumn("_t", F.to_date(target))
    asks = req.select(*key, "_t").distinct()
    asked = asks.select(*key, F.col("_t").alias("_d"), F.lit(0).alias("_kind"), F.lit(None).cast(st.schema["_st"].dataType).alias("_st"))
    w = Window.partitionBy(*key).orderBy("_d", "_kind").rowsBetween(Window.unboundedPreceding, -1)  # an asked day comes before its state
    u = asked.unionByName(st.select(*key, "_d", F.lit(1).alias("_kind"), "_st"))
    got = u.select(*key, F.col("_d").alias("_t"), "_kind", F.last("_st", ignorenulls=True).over(w).alias("_st")).where("_kind = 0")
    out = _match(req, got.select(*key, "_t", "_st.*"), [*key, "_t"]).drop("_t")
    out = out.withColumn("weeks_since_start", F.floor(F.datediff(F.to_date(target), F.col("s_first")) / 7))
    out = out.withColumn("n_hist", F.coalesce(F.col("s_n"), F.lit(0)))
    if cold_default is not None:
        for c in ("s_lag_1", "s_lag_2", "s_ema", "s_roll4"):
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(cold_default) if not isinstance(cold_default, Column)
                                               else cold_default))
    return out.drop("s_n", "s_first")


DEFAULT_HALF_STD = 0.263


def uncertainty(requests: DataFrame, history: DataFrame, fine: tuple[Sequence[str], Sequence[str]],
                coarse: tuple[Sequence[str], Sequence[str]], value: str, z: float = 1.28,
                default_std: float = DEFAULT_HALF_STD, min_fine: int = 5, min_coarse: int = 10) -> DataFrame:
    """Std of history in the request's fine cell when it has >= 5
    rows, else its coarse cell with >= 10 rows, else a default; the 80%
    half-width is z * std rounded to 3, with the source labelled."""
    (fr, fh), (cr, ch) = fine, coarse
    f = history.groupBy(*[F.col(h).alias(r) for h, r in zip(fh, fr)]).agg(
        F.count(value).alias("_fn"), F.stddev_samp(value).alias("_fs"))
    c = history.groupBy(*[F.col(h).alias(r) for h, r in zip(ch, cr)]).agg(
        F.count(value).alias("_cn"), F.stddev_samp(value).alias("_cs"))
    r = requests.join(f, list(fr), "left").join(c, list(cr), "left")
    use_f = F.coalesce(F.col("_fn"), F.lit(0)) >= min_fine
    use_c = F.coalesce(F.col("_cn"), F.lit(0)) >= min_coarse
    std = F.when(use_f, F.col("_fs")).when(use_c, F.col("_cs")).otherwise(F.lit(default_std))
    return (r.withColumn("half_width", F.round(std * z, 3))
            .withColumn("n_used", F.when(use_f, F.col("_fn")).when(use_c, F.col("_cn")).otherwise(F.lit(0)).cast("bigint"))
            .withColumn("unc_source", F.when(use_f, "entity_slot").when(use_c, "slot").otherwise("default"))
            .drop("_fn", "_fs", "_cn", "_cs"))
