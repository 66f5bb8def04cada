"""Equi / anti / semi / fallback joins (survey J1-J3, J10-J20).

Dimension-side lookups go through :func:`lookup`, which broadcasts the
small side only after a bounded count; otherwise Spark shuffles both
sides on the key (and AQE may still switch at run time).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecast.functions.scalars import NO_TAG, div0
from ratecast.session import bounded_broadcast


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "inner",
           take: Sequence[str] | None = None, small: bool = False) -> DataFrame:
    """Join ``dim`` (optionally only ``take`` columns) onto ``df``.
    ``small=True`` requests a size-checked broadcast of ``dim``."""
    on = [on] if isinstance(on, str) else list(on)
    d = dim.select(*on, *(take or [c for c in dim.columns if c not in on]))
    if small:
        d = bounded_broadcast(d)
    return df.join(d, on, how)


def cascade_mean(train: DataFrame, test: DataFrame, levels: Sequence[Sequence[str]], value: str,
                 out: str = "pred", level_out: str | None = None) -> DataFrame:
    """Mean of ``value`` on the most specific level whose key is
    seen in ``train``; the global train mean last.  One aggregate per
    level (map-side combined), then left joins on the small level tables."""
    res = test
    picks = []
    for i, lv in enumerate(levels):
        lv = list(lv)
        m = train.groupBy(*lv).agg(F.avg(value).alias(f"_lvl{i}"))
        res = res.join(m, lv, "left")
        picks.append(F.col(f"_lvl{i}"))
    g = train.agg(F.avg(value)).scalar()
    res = res.withColumn(out, F.coalesce(*picks, g))
    if level_out:
        lvl = F.lit(len(levels))
        for i in reversed(range(len(levels))):
            lvl = F.when(F.col(f"_lvl{i}").isNotNull(), F.lit(i)).otherwise(lvl)
        res = res.withColumn(level_out, lvl)
    return res.drop(*[f"_lvl{i}" for i in range(len(levels))])


def recent_weekday_mean(train: DataFrame, test: DataFrame, date: str, value: str, weeks: int = 8,
                        out: str = "pred") -> DataFrame:
    """Mean of the same weekday from ``weeks`` weeks before the last
    train date on, that date included, else the mean of all train."""
    last = train.agg(F.max(F.to_date(date))).scalar()
    recent = train.where(F.to_date(date) >= F.date_sub(last, 7 * weeks))
    by_dow = recent.groupBy(F.dayofweek(F.to_date(date)).alias("_dow")).agg(F.avg(value).alias("_m"))
    g = train.agg(F.avg(value)).scalar()
    res = test.withColumn("_dow", F.dayofweek(F.to_date(date))).join(by_dow, "_dow", "left")
    return res.withColumn(out, F.coalesce(F.col("_m"), g)).drop("_dow", "_m")


def unseen(df: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``known``."""
    return df.join(known.select(*key), list(key), "left_anti")


def in_set(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    return df.join(other.select(*key), list(key), "left_semi")


def apply_corrections(df: DataFrame, corr: DataFrame, keys: Sequence[str], pred: str,
                      shift: str = "correction", out: str = "pred_corrected") -> DataFrame:
    """Add the per-cell shift (0 when the cell has none)."""
    c = corr.select(*keys, F.col(shift).alias("_shift"))
    return (df.join(c, list(keys), "left")
            .withColumn(out, F.col(pred) + F.coalesce(F.col("_shift"), F.lit(0.0))).drop("_shift"))


def align_series(df: DataFrame, other: DataFrame, date: str, value: str, out: str) -> DataFrame:
    """Look up ``other``'s value by date; null when missing."""
    o = other.select(F.to_date(date).alias("_d"), F.col(value).alias(out))
    return df.withColumn("_d", F.to_date(date)).join(o, "_d", "left").drop("_d")


def calendar_fill(df: DataFrame, date: str, count: str, start=None, end=None) -> DataFrame:
    """One row per calendar day between the first and last date (or
    the given bounds), missing days filled with 0."""
    d = F.to_date(date)
    lo = start if start is not None else df.agg(F.min(d)).scalar()
    hi = end if end is not None else df.agg(F.max(d)).scalar()
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias(date))
    facts = df.select(d.alias(date), F.col(count))
    return (spine.join(facts, date, "left")
            .withColumn(count, F.coalesce(F.col(count), F.lit(0)).cast("bigint")))


def interpolate_daily(df: DataFrame, date: str, value: str, out: str | None = None) -> DataFrame:
    """Daily spine between first and last date; gaps filled by linear
    interpolation in time between the nearest known neighbours.

    The spine has one row per day, so the unpartitioned window here is
    bounded by the calendar, not by the data volume.
    """
    out = out or value
    d = F.to_date(date)
    lo, hi = df.agg(F.min(d)).scalar(), df.agg(F.max(d)).scalar()
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias("_d"))
    s = spine.join(df.select(d.alias("_d"), F.col(value).alias("_v")), "_d", "left")
    pt = F.when(F.col("_v").isNotNull(), F.struct(F.col("_d").alias("d"), F.col("_v").alias("v")))
    wp = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    wn = Window.orderBy("_d").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("_p", F.last(pt, ignorenulls=True).over(wp)).withColumn("_n", F.first(pt, ignorenulls=True).over(wn))
    span = F.datediff(F.col("_n.d"), F.col("_p.d"))
    interp = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * div0(F.datediff(F.col("_d"), F.col("_p.d")), span)
    val = F.when(F.col("_v").isNotNull(), F.col("_v")).when(span > 0, interp)
    return s.select(F.col("_d").alias(date), val.alias(out))


def match_level(df: DataFrame, tag: str, levels: Sequence[str], out: str = "level",
                default: str = NO_TAG) -> DataFrame:
    """The known level equal to the tag, else the first level (in
    list order) that contains the tag or is contained in it, else the
    default.  Levels are a short fixed list, so this is a chain of
    column expressions rather than a join."""
    t = F.col(tag)
    expr = None
    for lv in levels:
        c = t == F.lit(lv)
        expr = F.when(c, F.lit(lv)) if expr is None else expr.when(c, F.lit(lv))
    for lv in levels:
        c = F.lit(lv).contains(t) | t.contains(F.lit(lv))
        expr = expr.when(c, F.lit(lv))
    return df.withColumn(out, F.when(t.isNull() | (t == F.lit(default)), F.lit(default))
                         .otherwise(expr.otherwise(F.lit(default))))


def count_mismatches(a: DataFrame, b: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per compared column, the number of key-matched rows whose
    values differ (null-safe)."""
    bb = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in cols])
    j = a.select(*key, *cols).join(bb, list(key), "inner")
    aggs = [F.sum((~F.col(c).eqNullSafe(F.col(f"_b_{c}"))).cast("int")).cast("bigint").alias(c) for c in cols]
    wide = j.agg(F.count("*").alias("_rows"), *aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr("_rows AS n_rows", f"stack({len(cols)}, {stack}) AS (column, n_mismatch)")


def compare_preds(df: DataFrame, actual: str, a: str, b: str, tie: float = 0.02) -> DataFrame:
    """Per-row absolute errors of two predictions and the winner
    (``tie`` when the errors differ by less than the band)."""
    ea = F.abs(F.col(a) - F.col(actual))
    eb = F.abs(F.col(b) - F.col(actual))
    return (df.withColumn("err_a", ea).withColumn("err_b", eb)
            .withColumn("winner", F.when(F.abs(ea - eb) < tie, "tie").when(ea < eb, "a").otherwise("b")))
