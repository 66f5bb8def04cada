"""Date-interval joins (survey J4-J9, T16-T19).

Plan shape: the interval table is exploded to one row per covered day and
reduced *on the interval side* to one row per calendar day (tags, max
severity, latest-started interval).  The fact side then needs a single
many-to-one equi join on the date -- no range join over fact rows, no
fan-out, no group-by over fact rows afterwards.  The day table is bounded
by the calendar span of the intervals, and it is broadcast only after a
bounded count proves it small (otherwise a shuffle join with AQE skew
handling takes over).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecast.functions.scalars import NO_TAG
from ratecast.session import bounded_broadcast


def interval_days(iv: DataFrame, start: str = "start_date", end: str = "end_date",
                  out: str = "_d") -> DataFrame:
    """One row per (interval, covered day); ends are inclusive, rows with a
    null or reversed end are skipped (T19)."""
    s, e = F.to_date(start), F.to_date(end)
    return (iv.where(s.isNotNull() & e.isNotNull() & (e >= s))
            .withColumn(out, F.explode(F.sequence(s, e))))


def _ordered_concat(name: str, ordc: str, cond, sep: str):
    """Names of matching intervals joined by ``sep`` in ``ordc`` order."""
    items = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(ordc).alias("o"), F.col(name).alias("n")))))
    return F.array_join(F.transform(items, lambda x: x["n"]), sep)


def day_table(iv: DataFrame, specs: Sequence[dict], *, category: str = "category",
              name: str = "name", start: str = "start_date", end: str = "end_date",
              ord: str = "ord", severity: str = "severity") -> DataFrame:
    """Reduce intervals to one row per day.

    Each spec is ``{"out": col, "kind": k, "cats": [...]}`` with kind:
    ``last`` (name of the highest-``ord`` active interval, T16),
    ``concat`` (all active names in ``ord`` order joined by ' + ', T17),
    ``max_severity`` (J6), ``latest`` (struct of name/start/severity of
    the latest-started active interval, ties broken by ``ord``, J7).
    """
    d = interval_days(iv, start, end)
    aggs = []
    for sp in specs:
        cats = sp.get("cats")
        cond = F.col(category).isin(list(cats)) if cats else F.lit(True)
        k = sp["kind"]
        if k == "last":
            aggs.append(F.max_by(F.when(cond, F.col(name)), F.when(cond, F.col(ord))).alias(sp["out"]))
        elif k == "concat":
            aggs.append(F.nullif(_ordered_concat(name, ord, cond, sp.get("sep", " + ")), F.lit(""))
                        .alias(sp["out"]))
        elif k == "max_severity":
            aggs.append(F.max(F.when(cond, F.col(severity))).alias(sp["out"]))
        elif k == "latest":
            val = F.struct(F.col(name).alias("name"), F.to_date(start).alias("start"),
                           F.col(severity).alias("severity"))
            key = F.struct(F.to_date(start).alias("s"), F.col(ord).alias("o"))
            aggs.append(F.max_by(F.when(cond, val), F.when(cond, key)).alias(sp["out"]))
        else:
            raise ValueError(f"unknown interval spec kind {k!r}")
    return d.groupBy("_d").agg(*aggs)


def tag_with_days(df: DataFrame, days: DataFrame, date: str) -> DataFrame:
    """Left-join a day table to the facts on the fact's calendar date."""
    days = bounded_broadcast(days)
    return (df.withColumn("_d", F.to_date(date)).join(days, "_d", "left").drop("_d"))


def interval_tag(df: DataFrame, iv: DataFrame, date: str, *, out: str, mode: str = "last",
                 cats: Sequence[str] | None = None, default: str = NO_TAG, **cols) -> DataFrame:
    """One tag column (``last`` or ``concat``), ``default`` when no
    interval is active.  Row count is preserved."""
    days = day_table(iv, [{"out": out, "kind": mode, "cats": cats}], **cols)
    return tag_with_days(df, days, date).withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def tag_events(df: DataFrame, iv: DataFrame, date: str, *, season: Sequence[str], holiday: Sequence[str],
               security: Sequence[str], default: str = NO_TAG, **cols) -> DataFrame:
    """The full ingest tagging (T16-T18) in one join: season (last),
    holiday (last), security (concat), flags and the unified event."""
    specs = [{"out": "tag_season", "kind": "last", "cats": season},
             {"out": "tag_holiday", "kind": "last", "cats": holiday},
             {"out": "tag_security", "kind": "concat", "cats": security}]
    out = tag_with_days(df, day_table(iv, specs, **cols), date)
    for c in ("tag_season", "tag_holiday", "tag_security"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return (out.withColumn("is_holiday", F.col("tag_holiday") != default)
            .withColumn("is_security", F.col("tag_security") != default)
            .withColumn("special_event", F.when(F.col("tag_security") != default, F.col("tag_security"))
                        .when(F.col("tag_holiday") != default, F.col("tag_holiday"))
                        .otherwise(F.lit(default))))


def interval_max(df: DataFrame, iv: DataFrame, date: str, *, out: str = "severity_max",
                 cats: Sequence[str] | None = None, default: int = 0, **cols) -> DataFrame:
    """Max severity over the active intervals, ``default`` when none."""
    days = day_table(iv, [{"out": out, "kind": "max_severity", "cats": cats}], **cols)
    return tag_with_days(df, days, date).withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def latest_active(df: DataFrame, iv: DataFrame, date: str, *, cats: Sequence[str] | None = None,
                  **cols) -> DataFrame:
    """Days since the start of the latest-started active interval and
    its severity; (null, 0) when none is active."""
    days = day_table(iv, [{"out": "_la", "kind": "latest", "cats": cats}], **cols)
    t = tag_with_days(df, days, date)
    return (t.withColumn("event_start", F.col("_la.start"))
            .withColumn("days_since_start", F.datediff(F.to_date(date), F.col("_la.start")))
            .withColumn("event_severity", F.coalesce(F.col("_la.severity"), F.lit(0)))
            .drop("_la"))


def count_since_start(df: DataFrame, key: Sequence[str], date: str, start: str = "event_start",
                      out: str = "n_since_start") -> DataFrame:
    """Rows of the same series dated between ``start`` and the row's
    date (inclusive); 0 when ``start`` is null or after the date.

    The difference of two running day totals of the series: up to the date,
    and up to the day before the start.  Both are looked up in one window
    per series over its days and the distinct starts asked for, and the
    rows join the counts per (series, date, start) by equality.
    """
    key = list(key)
    d = F.to_date(date)
    dated = df.select(*key, d.alias("_d"), F.to_date(start).alias("_s"))
    per_day = dated.groupBy(*key, "_d").agg(F.count("*").alias("_n"))
    need = dated.where(F.col("_s").isNotNull() & (F.col("_s") <= F.col("_d"))).distinct()
    # a start stands before the same day's total: the running sum there excludes that day
    marks = per_day.select(*key, F.col("_d").alias("_at"), F.lit(1).alias("_kind"), "_n").unionByName(
        need.select(*key, F.col("_s").alias("_at")).distinct().withColumn("_kind", F.lit(0)).withColumn("_n", F.lit(0).cast("bigint")))
    w = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = marks.select(*key, "_at", "_kind", F.sum("_n").over(w).alias("_sum"))
    upto = marks.where("_kind = 1").select(*key, F.col("_at").alias("_d"), F.col("_sum").alias("_upto"))
    before = marks.where("_kind = 0").select(*key, F.col("_at").alias("_s"), F.col("_sum").alias("_before"))
    counts = need.join(upto, [*key, "_d"]).join(before, [*key, "_s"]).select(*key, "_d", "_s", (F.col("_upto") - F.col("_before")).alias(out))
    res = (df.withColumn("_d", d).withColumn("_s", F.to_date(start))
           .join(counts, [*key, "_d", "_s"], "left")
           .withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("bigint")))
    return res.drop("_d", "_s")


def per_interval(df: DataFrame, iv: DataFrame, date: str, values: Sequence[str], *,
                 cats: Sequence[str] | None = None, category: str = "category", name: str = "name",
                 start: str = "start_date", end: str = "end_date", key: str | None = None) -> DataFrame:
    """Per interval (overlaps allowed), the row count and the mean of
    each value over facts dated inside it; intervals with no rows dropped.

    Facts are pre-aggregated per day (sum, non-null count) before they
    meet the exploded intervals.
    """
    d = F.to_date(date)
    aggs = [F.count("*").alias("_n")]
    for v in values:
        aggs += [F.sum(v).alias(f"_s_{v}"), F.count(v).alias(f"_c_{v}")]
    daily = df.groupBy(d.alias("_d")).agg(*aggs)
    ivs = iv if not cats else iv.where(F.col(category).isin(list(cats)))
    ivk = [key] if key else []
    days = interval_days(ivs.select(*ivk, name, start, end), start, end)
    j = days.join(daily, "_d")
    outs = [F.sum("_n").alias("n")]
    for v in values:
        outs.append(F.try_divide(F.sum(f"_s_{v}"), F.sum(f"_c_{v}")).alias(f"mean_{v}"))
    return j.groupBy(*ivk, name, F.to_date(start).alias(start), F.to_date(end).alias(end)).agg(*outs)
