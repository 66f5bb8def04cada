"""Aggregation queries (A1-A45) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.functions.scalars import DAYPART_LABELS, daypart, safe_div
from ratecast.operators import aggregates as A
from ratecast.operators import windows as W
from ratecast.plans.predictions import MODELS, PRED_CTE, predictions, predictions_long, split_events
from ratecast.plans.registry import query, measure
from ratecast.plans.tables import EV_ORDER, EVENTS_SQL, events, table

EV = EVENTS_SQL


def _r(df, *keep):
    """Cast integral counts to bigint; all else stays."""
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            out.append(measure(c).alias(c))
        elif t in ("int", "smallint", "tinyint") and c not in keep:
            out.append(F.col(c).cast("bigint").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


_DP_SQL = ("CASE WHEN h BETWEEN 6 AND 9 THEN '{0}' WHEN h BETWEEN 10 AND 13 THEN '{1}' "
           "WHEN h BETWEEN 14 AND 17 THEN '{2}' WHEN h BETWEEN 18 AND 21 THEN '{3}' "
           "WHEN h >= 22 OR h <= 1 THEN '{4}' ELSE '{5}' END").format(*[x.replace("'", "''") for x in DAYPART_LABELS])


# A1 -----------------------------------------------------------------------------
@query("group_profile", f"""SELECT event_type, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean,
  (median(value)) AS median, (avg(k)) AS mean_k FROM {EV} GROUP BY event_type""")
def q_group_profile(spark, sf):
    return _r(A.profile(events(spark, sf), ["event_type"], "value", extra=["k"]))


# A2 -----------------------------------------------------------------------------
@query("weekday_profile", f"""WITH p AS (SELECT dow, CAST(count(*) AS BIGINT) AS n, avg(value) AS mean, median(value) AS median
  FROM {EV} GROUP BY dow)
SELECT dow, n, (mean) AS mean, (median) AS median,
  dow = (SELECT dow FROM p ORDER BY mean DESC, dow DESC LIMIT 1) AS is_best,
  dow = (SELECT dow FROM p ORDER BY mean ASC, dow ASC LIMIT 1) AS is_worst,
  ((SELECT max(mean) / min(mean) FROM p)) AS best_worst_ratio FROM p""")
def q_weekday_profile(spark, sf):
    p = A.profile(events(spark, sf), ["dow"], "value")
    return _r(A.best_worst(p, "dow"))


# A3 -----------------------------------------------------------------------------
@query("hour_profile", f"""SELECT h, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean,
  (median(value)) AS median FROM {EV} GROUP BY h""")
def q_hour_profile(spark, sf):
    return _r(A.profile(events(spark, sf), ["h"], "value"))


@query("daypart_profile", f"""SELECT {_DP_SQL} AS daypart, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean,
  (median(value)) AS median FROM {EV} GROUP BY 1""")
def q_daypart_profile(spark, sf):
    return _r(A.profile(events(spark, sf), [daypart("h").alias("daypart")], "value"))


# A4 -----------------------------------------------------------------------------
@query("split_stats", f"""SELECT event_type = 'purchase' AS flag, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean,
  (median(value)) AS median, (stddev_samp(value)) AS std FROM {EV} GROUP BY 1""")
def q_split_stats(spark, sf):
    return _r(A.split_profile(events(spark, sf), F.col("event_type") == "purchase", "value"))


# A5 -----------------------------------------------------------------------------
_PAIRED = """SELECT l_partkey, count_if(l_returnflag = 'R') AS n_true, count_if(l_returnflag <> 'R') AS n_false,
  avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS mean_true,
  avg(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS mean_false
  FROM lineitem GROUP BY l_partkey HAVING count_if(l_returnflag = 'R') >= 5 AND count_if(l_returnflag <> 'R') >= 5"""


@query("paired_delta", f"""SELECT l_partkey, CAST(n_true AS BIGINT) AS n_true, CAST(n_false AS BIGINT) AS n_false,
  (mean_true) AS mean_true, (mean_false) AS mean_false, (mean_true - mean_false) AS delta
  FROM ({_PAIRED}) ORDER BY n_true DESC, l_partkey LIMIT 20""")
def q_paired_delta(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r(A.paired_delta(li, "l_partkey", F.col("l_returnflag") == "R", "l_extendedprice", 5, 20))


@query("paired_summary", f"""SELECT CAST(count(*) AS BIGINT) AS n_entities, (avg(mean_true - mean_false)) AS mean_delta,
  (median(mean_true - mean_false)) AS median_delta,
  (avg(CASE WHEN mean_true - mean_false > 0 THEN 1.0 ELSE 0.0 END)) AS share_positive FROM ({_PAIRED})""")
def q_paired_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r(A.paired_summary(li, "l_partkey", F.col("l_returnflag") == "R", "l_extendedprice", 5))


# A6, A7 ------------------------------------------------------------------------------
@query("share_where", f"""SELECT event_type, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean,
  (avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) * 100) AS pct_true FROM {EV} GROUP BY event_type""")
def q_share_where(spark, sf):
    return _r(A.share_where(events(spark, sf), ["event_type"], "value", F.col("value") > 50))


@query("status_share", f"""SELECT event_type, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean,
  (median(value)) AS median, (count(*) * 100.0 / (SELECT count(*) FROM events)) AS pct
  FROM {EV} GROUP BY event_type""")
def q_status_share(spark, sf):
    return _r(A.profile(events(spark, sf), ["event_type"], "value", pct_of_total=True))


# A8 ------------------------------------------------------------------------------
@query("zero_rate", """SELECT dayofweek(l_shipdate) = 6 AS split, CAST(count(*) AS BIGINT) AS n,
  (avg(l_discount)) AS mean, (count_if(l_discount = 0) / count(*)) AS zero_rate
  FROM lineitem GROUP BY 1""")
def q_zero_rate(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r(A.zero_rate(li, F.dayofweek("l_shipdate") == 7, "l_discount"))


# A9 ------------------------------------------------------------------------------
@query("top_entities", f"""SELECT user_id, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean FROM {EV}
  GROUP BY user_id HAVING count(*) >= 10 ORDER BY avg(value) DESC, user_id LIMIT 15""")
def q_top_entities(spark, sf):
    return _r(A.rank_entities(events(spark, sf), "user_id", "value", 10, 15))


@query("bottom_entities", """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, (avg(o_totalprice)) AS mean FROM orders
  GROUP BY o_custkey HAVING count(*) >= 5 ORDER BY avg(o_totalprice) ASC, o_custkey LIMIT 15""")
def q_bottom_entities(spark, sf):
    return _r(A.rank_entities(table(spark, sf, "orders"), "o_custkey", "o_totalprice", 5, 15, ascending=True))


# A10, A11 ---------------------------------------------------------------------------
@query("monthly_trend", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(count(*) AS BIGINT) AS n,
  (avg(o_totalprice)) AS mean_o_totalprice FROM orders GROUP BY 1""")
def q_monthly_trend(spark, sf):
    return _r(A.monthly_trend(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"]))


@query("monthly_top", """WITH o AS (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
b AS (SELECT month, CAST(count(*) AS BIGINT) AS n, avg(o_totalprice) AS mean, median(o_totalprice) AS median,
      CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS n_flagged FROM o GROUP BY month),
e AS (SELECT month, o_orderpriority, avg(o_totalprice) AS m FROM o GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT month, arg_max(printf('%s (%.2f)', o_orderpriority, m), m) AS top_entity FROM e GROUP BY month)
SELECT b.month, b.n, (b.mean) AS mean, (b.median) AS median, b.n_flagged, t.top_entity
FROM b LEFT JOIN t USING (month)""")
def q_monthly_top(spark, sf):
    o = table(spark, sf, "orders")
    return _r(A.monthly_top(o, "o_orderdate", "o_orderpriority", "o_totalprice", F.col("o_orderstatus") == "F", 5))


# A12 ------------------------------------------------------------------------------
@query("category_profile", f"""SELECT {_DP_SQL} AS daypart, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean,
  (median(value)) AS median FROM {EV} WHERE event_type = 'view' GROUP BY 1""")
def q_category_profile(spark, sf):
    ev = events(spark, sf).where(F.col("event_type") == "view")
    return _r(A.profile(ev, [daypart("h").alias("daypart")], "value"))


_CATS = ["view", "click", "purchase"]


@query("category_compare", f"""SELECT event_type, CAST(count(*) AS BIGINT) AS n, avg(value) AS mean, median(value) AS median,
  avg(k) AS mean_k FROM {EV} WHERE event_type IN ('view', 'click', 'purchase') GROUP BY event_type""")
def q_category_compare(spark, sf):
    """The category beside the others it is compared with."""
    return _r(A.profile(events(spark, sf).where(F.col("event_type").isin(_CATS)), ["event_type"], "value", extra=["k"]))


@query("category_top", f"""SELECT user_id, CAST(count(*) AS BIGINT) AS n, avg(value) AS mean FROM {EV} WHERE event_type = 'view'
  GROUP BY user_id HAVING count(*) >= 5 ORDER BY mean DESC, user_id LIMIT 5""")
def q_category_top(spark, sf):
    """The five best series of the category with at least five rows."""
    return _r(A.rank_entities(events(spark, sf).where(F.col("event_type") == "view"), "user_id", "value", 5, 5))


# A13, A14 ---------------------------------------------------------------------------
@query("heatmap_pivot", f"SELECT dow, " + ", ".join(
    f'(avg(value) FILTER (WHERE h = {h})) AS "{h}"' for h in range(24)) + f" FROM {EV} GROUP BY dow")
def q_heatmap_pivot(spark, sf):
    return _r(A.heatmap(events(spark, sf), "dow", "h", "value", list(range(24))))


@query("heatmap_shade", f"""WITH c AS (SELECT dow, h, avg(value) AS mean FROM {EV} GROUP BY dow, h)
SELECT dow, h, (mean) AS mean, CAST(least(floor(coalesce((mean - (SELECT min(mean) FROM c)) /
  nullif((SELECT max(mean) FROM c) - (SELECT min(mean) FROM c), 0), 0) * 4), 3) AS BIGINT) AS shade FROM c""")
def q_heatmap_shade(spark, sf):
    return _r(A.heat_shade(events(spark, sf), "dow", "h", "value"))


@query("pivot_mean_count", f"SELECT event_type, " + ", ".join(
    f'(avg(value) FILTER (WHERE dow = {d})) AS "{d}_mean", CAST(count(value) FILTER (WHERE dow = {d}) AS BIGINT) AS "{d}_n"'
    for d in range(1, 8)) + f" FROM {EV} GROUP BY event_type")
def q_pivot_mean_count(spark, sf):
    return _r(A.pivot_mean_count(events(spark, sf), "event_type", "dow", "value", list(range(1, 8))))


# A15 ------------------------------------------------------------------------------
@query("overview", f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT user_id) AS BIGINT) AS n_entities,
  min(d) AS first_date, max(d) AS last_date, CAST(count(DISTINCT d) AS BIGINT) AS n_days, (avg(value)) AS mean,
  (count_if(value = 0) / count(*)) AS zero_rate,
  (avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)) AS flag_rate,
  (SELECT user_id FROM (SELECT user_id, avg(value) AS m FROM {EV} GROUP BY user_id) ORDER BY m DESC, user_id DESC LIMIT 1)
    AS best_entity
  FROM {EV}""")
def q_overview(spark, sf):
    return _r(A.overview(events(spark, sf), "d", "user_id", "value", F.col("event_type") == "purchase"))


# A16 ------------------------------------------------------------------------------
_CP_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
            ("c_mktsegment", "string")]


def _cp_sql2():
    q = []
    for c, t in _CP_COLS:
        num = t in ("bigint", "int", "double")
        if num:
            st = (f"(min({c}::DOUBLE)) AS min, (median({c}::DOUBLE)) AS median, "
                  f"(avg({c}::DOUBLE)) AS mean, (stddev_samp({c}::DOUBLE)) AS std, "
                  f"(max({c}::DOUBLE)) AS max")
        else:
            st = "NULL::DOUBLE AS min, NULL::DOUBLE AS median, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS max"
        top = (f"(SELECT string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, "
               f"count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3))")
        q.append(f"SELECT '{c}' AS column, '{t}' AS dtype, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, "
                 f"CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, {st}, NULL::DOUBLE AS true_share, "
                 f"{top} AS top_values FROM customer")
    return " UNION ALL ".join(q)


@query("column_profile", _cp_sql2())
def q_column_profile(spark, sf):
    return _r(A.column_profile(table(spark, sf, "customer")))


# A17-A19 ---------------------------------------------------------------------------
@query("describe_pct", "SELECT CAST(count(l_extendedprice) AS BIGINT) AS count, (avg(l_extendedprice)) AS mean, "
       "(stddev_samp(l_extendedprice)) AS std, (min(l_extendedprice)) AS min, "
       "(max(l_extendedprice)) AS max, " + ", ".join(
           f"(quantile_cont(l_extendedprice, {p})) AS p{int(round(p * 100)):02d}" for p in A.PCTS)
       + " FROM lineitem")
def q_describe_pct(spark, sf):
    return _r(A.describe_pct(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("extremes", """SELECT CAST(count_if(l_discount = 0) AS BIGINT) AS n_zero, (count_if(l_discount = 0) / count(*)) AS zero_share,
  CAST(count_if(l_discount >= (SELECT quantile_cont(l_discount, 0.99) FROM lineitem)) AS BIGINT) AS n_ge_p99,
  (SELECT l_orderkey FROM lineitem ORDER BY l_discount DESC, l_orderkey DESC LIMIT 1) AS argmax_id FROM lineitem""")
def q_extremes(spark, sf):
    return _r(A.extremes(table(spark, sf, "lineitem"), "l_discount", "l_orderkey"))


@query("histogram", f"""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 10 AS w FROM events),
c AS (SELECT CAST(least(floor((value - (SELECT lo FROM s)) / (SELECT w FROM s)), 9) AS BIGINT) AS bin, count(*) AS n
      FROM events WHERE value IS NOT NULL GROUP BY 1),
b AS (SELECT range AS bin FROM range(10))
SELECT b.bin, ((SELECT lo FROM s) + b.bin * (SELECT w FROM s)) AS lo,
  ((SELECT lo FROM s) + (b.bin + 1) * (SELECT w FROM s)) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM b LEFT JOIN c USING (bin)""")
def q_histogram(spark, sf):
    return _r(A.histogram(events(spark, sf), "value", 10))


# A20 ------------------------------------------------------------------------------
_PM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("pearson_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, (corr({a}, {b})) AS r FROM lineitem" for a in _PM for b in _PM))
def q_pearson_matrix(spark, sf):
    return _r(A.pearson_matrix(table(spark, sf, "lineitem"), _PM))


# A22-A25 ---------------------------------------------------------------------------
@query("metrics", f"""WITH {PRED_CTE}
SELECT CAST(count(*) AS BIGINT) AS n, (avg(abs(pred_slot - actual))) AS mae,
  (sqrt(avg((pred_slot - actual) * (pred_slot - actual)))) AS rmse,
  (1 - sum((pred_slot - actual) * (pred_slot - actual)) / (var_pop(actual) * count(*))) AS r2 FROM pred""")
def q_metrics(spark, sf):
    return _r(A.metrics(predictions(spark, sf), "actual", "pred_slot"))


@query("error_summary", f"""WITH {PRED_CTE}
SELECT CAST(count(*) AS BIGINT) AS n, (avg(pred_slot - actual)) AS bias, (avg(abs(pred_slot - actual))) AS mae,
  (avg(CASE WHEN abs(pred_slot - actual) <= 0.2 THEN 1.0 ELSE 0.0 END)) AS within_0_2,
  (avg(CASE WHEN abs(pred_slot - actual) <= 0.5 THEN 1.0 ELSE 0.0 END)) AS within_0_5,
  (quantile_cont(pred_slot - actual, 0.1)) AS err_p10, (quantile_cont(pred_slot - actual, 0.5)) AS err_p50,
  (quantile_cont(pred_slot - actual, 0.9)) AS err_p90 FROM pred""")
def q_error_summary(spark, sf):
    return _r(A.error_summary(predictions(spark, sf), "actual", "pred_slot"))


@query("segment_mae", f"""WITH {PRED_CTE}
SELECT event_type, CAST(count(*) AS BIGINT) AS n, (avg(abs(actual - pred_slot))) AS mae,
  (avg(actual)) AS actual_mean, (avg(pred_slot)) AS pred_mean, (avg(actual - pred_slot)) AS bias
FROM pred GROUP BY event_type""")
def q_segment_mae(spark, sf):
    return _r(A.segment_errors(predictions(spark, sf), "actual", "pred_slot", "event_type"))


@query("model_matrix", f"""WITH {PRED_CTE}
SELECT event_type, """ + ", ".join(f"(avg(abs(pred - actual)) FILTER (WHERE model = '{m}')) AS \"{m}\""
                                   for m in MODELS) + " FROM plong GROUP BY event_type")
def q_model_matrix(spark, sf):
    return _r(A.model_matrix(predictions_long(spark, sf), "actual", "event_type", list(MODELS)))


# A26-A28 ---------------------------------------------------------------------------
_BOARD_SQL = """board AS (SELECT model, CAST(count(*) AS BIGINT) AS n, avg(abs(pred - actual)) AS mae,
    sqrt(avg((pred - actual) * (pred - actual))) AS rmse,
    1 - sum((pred - actual) * (pred - actual)) / (var_pop(actual) * count(*)) AS r2 FROM plong GROUP BY model)"""


@query("leaderboard", f"""WITH {PRED_CTE}, {_BOARD_SQL}
SELECT model, n, (mae) AS mae, (rmse) AS rmse, (r2) AS r2,
  (((SELECT mae FROM board WHERE model = 'global') - mae) * 100.0 / (SELECT mae FROM board WHERE model = 'global'))
    AS improvement_pct, CAST(row_number() OVER (ORDER BY mae, model) AS BIGINT) AS rank FROM board""")
def q_leaderboard(spark, sf):
    return _r(A.leaderboard(predictions_long(spark, sf), "actual", "global"), "rank")


FAMILIES = {"global": "constant", "weekday": "constant", "slot": "lookup", "user": "lookup"}


@query("family_summary", f"""WITH {PRED_CTE}, {_BOARD_SQL},
fam AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}', '{f}')" for m, f in FAMILIES.items()) + """) t(model, family))
SELECT coalesce(f.family, 'other') AS family, CAST(count(*) AS BIGINT) AS n_models, (min(mae)) AS best_mae,
  (max(mae)) AS worst_mae, (max(r2)) AS best_r2, arg_min(b.model, b.mae) AS leader
FROM board b LEFT JOIN fam f USING (model) GROUP BY 1""")
def q_family_summary(spark, sf):
    board = A.leaderboard(predictions_long(spark, sf), "actual", "global")
    return _r(A.family_summary(board, FAMILIES))


_DIFF_SQL = f"""WITH {PRED_CTE},
per AS (SELECT user_id, model, count(*) AS n, avg(abs(pred - actual)) AS mae FROM plong GROUP BY user_id, model),
dif AS (SELECT user_id, CAST(max(n) AS BIGINT) AS n, (avg(mae)) AS mae_mean, (min(mae)) AS mae_min,
  (max(mae)) AS mae_max, (stddev_pop(mae)) AS mae_std, CAST(count(*) AS BIGINT) AS n_models FROM per GROUP BY user_id HAVING max(n) >= 5)"""


def _difficulty(spark, sf):
    return A.difficulty(predictions_long(spark, sf), "user_id", "actual", 5)


@query("difficulty", f"{_DIFF_SQL} SELECT * FROM dif")
def q_difficulty(spark, sf):
    return _r(_difficulty(spark, sf))


@query("hardest_entities", f"{_DIFF_SQL} SELECT * FROM dif ORDER BY mae_min DESC, user_id LIMIT 10")
def q_hardest_entities(spark, sf):
    return _r(A.hardest(_difficulty(spark, sf), "user_id", 10))


@query("divergent_entities", f"{_DIFF_SQL} SELECT * FROM dif ORDER BY mae_std DESC, user_id LIMIT 10")
def q_divergent_entities(spark, sf):
    return _r(A.most_divergent(_difficulty(spark, sf), "user_id", 10))


# A29-A31 ---------------------------------------------------------------------------
@query("daily_rollup", f"""SELECT d AS ds, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS value, (avg(k)) AS k,
  CAST(max(CAST(value > 300 AS INTEGER)) AS BIGINT) AS high FROM {EV} GROUP BY d""")
def q_daily_rollup(spark, sf):
    ev = events(spark, sf).withColumn("high", F.col("value") > 300)
    return _r(A.daily(ev, "d", ["value", "k"], ["high"]))


@query("weekly_errors", f"""WITH {PRED_CTE}
SELECT CAST(date_trunc('week', d) AS DATE) AS week, CAST(count(*) AS BIGINT) AS n,
  (avg(abs(pred_slot - actual))) AS mae, (avg(pred_slot - actual)) AS bias FROM pred GROUP BY 1""")
def q_weekly_errors(spark, sf):
    return _r(A.weekly_errors(predictions(spark, sf), "d", "actual", "pred_slot"))


_MAG = [0, 10, 50, 100, 200, 1000, None]


def _bins_sql(col, edges, right=False):
    parts = []
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1]
        cond = f"{col} {'>' if right else '>='} {a}"
        if b is not None:
            cond += f" AND {col} {'<=' if right else '<'} {b}"
        parts.append((cond, f"{a}+" if b is None else f"{a}-{b}", i))
    lab = "CASE " + " ".join(f"WHEN {c} THEN '{lb}'" for c, lb, _ in parts) + " END"
    order = "CASE " + " ".join(f"WHEN {c} THEN {i}" for c, _, i in parts) + " END"
    return lab, order


_ML, _MO = _bins_sql("actual", _MAG, right=True)


@query("magnitude_bins", f"""WITH {PRED_CTE}
SELECT {_ML} AS bin, CAST({_MO} AS BIGINT) AS bin_order, CAST(count(*) AS BIGINT) AS n,
  (avg(abs(pred_slot - actual))) AS mae FROM pred WHERE {_ML} IS NOT NULL GROUP BY 1, 2""")
def q_magnitude_bins(spark, sf):
    p = predictions(spark, sf)
    return _r(A.binned(p, "actual", _MAG, right=True, aggs={"mae": F.avg(F.abs(F.col("pred_slot") - F.col("actual")))}))


# A32, A33 ---------------------------------------------------------------------------
@query("entity_profile", f"""WITH {PRED_CTE},
g AS (SELECT user_id, count(*) AS n, avg(actual) AS mean, stddev_samp(actual) AS std, avg(abs(pred_slot - actual)) AS mae
      FROM pred GROUP BY user_id HAVING count(*) >= 5)
SELECT user_id, CAST(n AS BIGINT) AS n, (mean) AS mean, (std) AS std, (mae) AS mae,
  (std / greatest(mae, 0.01)) AS learnability, (mae / greatest(mean, 0.05)) AS rel_mae FROM g""")
def q_entity_profile(spark, sf):
    return _r(A.entity_profile(predictions(spark, sf), "user_id", "actual", "pred_slot", 5))


_CS = [0, 2, 5, 10, 20, 40, 80, 200, 1000, None]
_CL, _CO = _bins_sql("lag_n", _CS)
_EMW = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("cold_start", f"""WITH x AS (SELECT value, count(*) OVER {_EMW} AS lag_n,
  coalesce(sum(value) OVER {_EMW}, 0) / nullif(count(*) OVER {_EMW}, 0) AS lag_mean FROM {EV})
SELECT {_CL} AS bin, CAST({_CO} AS BIGINT) AS bin_order, CAST(count(*) AS BIGINT) AS n,
  (avg(abs(lag_mean - value))) AS mae, (avg(lag_mean - value)) AS bias, (avg(value)) AS actual_mean
FROM x WHERE lag_n > 0 AND {_CL} IS NOT NULL GROUP BY 1, 2""")
def q_cold_start(spark, sf):
    ev = events(spark, sf)
    x = W.expanding_mean(ev, ["user_id"], "value", EV_ORDER, out="lag_mean", out_n="lag_n")
    x = x.where(F.col("lag_n") > 0)
    e = F.col("lag_mean") - F.col("value")
    return _r(A.binned(x, "lag_n", _CS, aggs={"mae": F.avg(F.abs(e)), "bias": F.avg(e), "actual_mean": F.avg("value")}))


# A34 ------------------------------------------------------------------------------
_BC = """cells AS (SELECT event_type, dow, count(*) AS n, avg(actual - pred_slot) AS bias FROM pred GROUP BY event_type, dow
  HAVING count(*) >= 30 AND abs(avg(actual - pred_slot)) >= 0.1)"""


@query("bias_corrections", f"""WITH {PRED_CTE}, {_BC}
SELECT event_type, dow, CAST(n AS BIGINT) AS n, (bias) AS bias, (greatest(least(bias, 0.3), -0.3)) AS correction
FROM cells""")
def q_bias_corrections(spark, sf):
    return _r(A.bias_cells(predictions(spark, sf), ["event_type", "dow"], "actual", "pred_slot"))


@query("bias_corrected_mae", f"""WITH {PRED_CTE}, {_BC}
SELECT (avg(abs(p.pred_slot - p.actual))) AS mae_before,
  (avg(abs(p.pred_slot + CASE WHEN c.bias IS NULL THEN 0 ELSE greatest(least(c.bias, 0.3), -0.3) END - p.actual))) AS mae_after
FROM pred p LEFT JOIN cells c USING (event_type, dow)""")
def q_bias_corrected_mae(spark, sf):
    from ratecast.operators import joins as J
    p = predictions(spark, sf)
    cells = A.bias_cells(p, ["event_type", "dow"], "actual", "pred_slot")
    c = J.apply_corrections(p, cells, ["event_type", "dow"], "pred_slot")
    return _r(c.agg(F.avg(F.abs(F.col("pred_slot") - F.col("actual"))).alias("mae_before"),
                    F.avg(F.abs(F.col("pred_corrected") - F.col("actual"))).alias("mae_after")))


# A35 ------------------------------------------------------------------------------
@query("cluster_summary", f"""WITH vc AS (SELECT event_type, h, count(*) AS c FROM {EV} GROUP BY ALL),
mx AS (SELECT event_type, max(c) AS mc FROM vc GROUP BY ALL),
md AS (SELECT vc.event_type, min(h) AS mode_h FROM vc JOIN mx ON vc.event_type = mx.event_type AND vc.c = mx.mc GROUP BY ALL)
SELECT e.event_type, CAST(count(*) AS BIGINT) AS n, (avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END)) AS share_high,
  (avg(CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END)) AS share_k50, any_value(md.mode_h) AS mode_h
FROM {EV} e JOIN md USING (event_type) GROUP BY e.event_type""")
def q_cluster_summary(spark, sf):
    ev = events(spark, sf)
    return _r(A.cluster_summary(ev, "event_type", {"high": F.col("value") > 100, "k50": F.col("k") > 50}, ["h"]))


# A37, A38, A39 ------------------------------------------------------------------------
@query("coverage", f"""WITH {PRED_CTE}
SELECT CAST(count(*) AS BIGINT) AS n,
  (avg(CASE WHEN actual BETWEEN pred_slot * 0.5 AND pred_slot * 1.5 THEN 1.0 ELSE 0.0 END)) AS coverage,
  (avg(pred_slot * 1.5 - pred_slot * 0.5)) AS mean_width,
  (avg(CASE WHEN actual < pred_slot * 0.5 THEN 1.0 ELSE 0.0 END)) AS below,
  (avg(CASE WHEN actual > pred_slot * 1.5 THEN 1.0 ELSE 0.0 END)) AS above FROM pred""")
def q_coverage(spark, sf):
    p = predictions(spark, sf).withColumn("lo", F.col("pred_slot") * 0.5).withColumn("hi", F.col("pred_slot") * 1.5)
    return _r(A.coverage(p, "actual", "lo", "hi"))


@query("coverage_by_width", f"""WITH {PRED_CTE},
x AS (SELECT actual, pred_slot * 0.5 AS lo, pred_slot * 1.5 AS hi, pred_slot * 1.5 - pred_slot * 0.5 AS w FROM pred),
s AS (SELECT min(w) AS mn, (max(w) - min(w)) / 5 AS st FROM x)
SELECT CAST(CASE WHEN w <= mn + st THEN 0 WHEN w <= mn + st * 2 THEN 1 WHEN w <= mn + st * 3 THEN 2
  WHEN w <= mn + st * 4 THEN 3 WHEN w <= mn + st * 5 THEN 4 ELSE 4 END AS BIGINT) AS width_bin, CAST(count(*) AS BIGINT) AS n,
  (avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)) AS coverage, (avg(w)) AS mean_width
FROM x, s GROUP BY 1""")
def q_coverage_by_width(spark, sf):
    p = predictions(spark, sf).withColumn("lo", F.col("pred_slot") * 0.5).withColumn("hi", F.col("pred_slot") * 1.5)
    return _r(A.coverage_by_width(p, "actual", "lo", "hi", 5))


@query("model_spread", f"""WITH {PRED_CTE},
x AS (SELECT event_id, (pred_global + pred_slot + pred_user + pred_weekday) / 4 AS m, * FROM pred)
SELECT event_id, (sqrt(((pred_global - m) * (pred_global - m) + (pred_slot - m) * (pred_slot - m) +
  (pred_user - m) * (pred_user - m) + (pred_weekday - m) * (pred_weekday - m)) / 3)) AS spread FROM x""")
def q_model_spread(spark, sf):
    p = A.model_spread(predictions(spark, sf), list(MODELS.values()))
    return _r(p.select("event_id", "spread"))


@query("status_bias", f"""WITH {PRED_CTE}
SELECT event_type, CAST(count(actual) AS BIGINT) AS n, avg(pred_slot - actual) AS bias, avg(abs(pred_slot - actual)) AS mae,
  avg(actual) AS actual_mean FROM pred GROUP BY event_type""")
def q_status_bias(spark, sf):
    return _r(A.status_bias(predictions(spark, sf), "event_type", "actual", "pred_slot"))


@query("cluster_error_summary", f"""WITH {PRED_CTE}
SELECT event_type, CAST(count(*) AS BIGINT) AS n, avg(abs(actual - pred_slot)) AS mean_abs_err, avg(actual - pred_slot) AS mean_bias,
  avg(actual) AS mean_actual, avg(CASE WHEN dow IN (6, 7) THEN 1.0 ELSE 0.0 END) AS share_weekend FROM pred GROUP BY event_type""")
def q_cluster_error_summary(spark, sf):
    """Mean error, bias and actual per group beside a share."""
    err = F.col("actual") - F.col("pred_slot")
    return _r(A.cluster_summary(predictions(spark, sf), "event_type", {"weekend": F.col("dow").isin(6, 7)}, [],
                                {"abs_err": F.abs(err), "bias": err, "actual": F.col("actual")}))


@query("guarded_ratio", f"SELECT event_id, CASE WHEN k > 0 THEN value / k END AS ratio FROM {EV}")
def q_guarded_ratio(spark, sf):
    """Value per unit of k, only where k is positive."""
    return events(spark, sf).select("event_id", safe_div("value", "k").alias("ratio"))


@query("drift_pct", f"""WITH {PRED_CTE}
SELECT (avg(value) FILTER (WHERE d < (SELECT cut FROM cutrow))) AS train_mean,
  (avg(value) FILTER (WHERE d >= (SELECT cut FROM cutrow))) AS test_mean,
  ((avg(value) FILTER (WHERE d >= (SELECT cut FROM cutrow)) - avg(value) FILTER (WHERE d < (SELECT cut FROM cutrow)))
    * 100.0 / avg(value) FILTER (WHERE d < (SELECT cut FROM cutrow))) AS drift_pct FROM ev""")
def q_drift_pct(spark, sf):
    return _r(A.drift_pct(split_events(spark, sf), "split", "value"))


# A40-A45 --------------------------------------------------------------------------
@query("catalog", """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, min(CAST(o_orderdate AS DATE)) AS first_date,
  max(CAST(o_orderdate AS DATE)) AS last_date, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_o_orderpriority,
  arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_o_orderstatus FROM orders GROUP BY o_custkey""")
def q_catalog(spark, sf):
    o = table(spark, sf, "orders")
    return _r(A.catalog(o, "o_custkey", "o_orderdate", ["o_orderpriority", "o_orderstatus"], ["o_orderdate", "o_orderkey"]))


@query("usage", f"""SELECT event_type, CAST(count(*) AS BIGINT) AS n,
  CAST(count_if(ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS BIGINT) AS n_recent,
  (SELECT CAST(count(*) AS BIGINT) FROM events) AS total,
  (SELECT CAST(count_if(ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS BIGINT) FROM events) AS total_recent
  FROM events GROUP BY event_type""")
def q_usage(spark, sf):
    ev = table(spark, sf, "events")
    as_of = ev.agg(F.max("ts")).scalar()
    return _r(A.usage(ev, "ts", "event_type", as_of, 7))


@query("entity_mean", f"""SELECT user_id, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {EV}
  WHERE value IS NOT NULL) WHERE rn <= 500 GROUP BY user_id""")
def q_entity_mean(spark, sf):
    return _r(A.entity_mean(events(spark, sf), ["user_id"], "value", EV_ORDER, limit=500))


@query("entity_mean_all", f"SELECT event_type, h, CAST(count(value) AS BIGINT) AS n, avg(value) AS mean FROM {EV} WHERE value IS NOT NULL GROUP BY event_type, h")
def q_entity_mean_all(spark, sf):
    return _r(A.entity_mean(events(spark, sf), ["event_type", "h"], "value", EV_ORDER))


_SEV = [0, 1, 4, 7, 11]
_SL, _SO = _bins_sql("severity_max", _SEV)


@query("severity_bins", f"""WITH x AS (SELECT coalesce((SELECT max(i.severity) FROM {{IV}} i WHERE i.category IN ('security', 'political')
  AND i.end_date IS NOT NULL AND e.d BETWEEN i.start_date AND i.end_date), 0) AS severity_max FROM {EV} e)
SELECT {_SL} AS bin, CAST({_SO} AS BIGINT) AS bin_order, CAST(count(*) AS BIGINT) AS n FROM x
WHERE {_SL} IS NOT NULL GROUP BY 1, 2""".replace("{IV}", __import__("ratecast.plans.tables", fromlist=["x"]).INTERVALS_SQL))
def q_severity_bins(spark, sf):
    from ratecast.operators import intervals as I
    from ratecast.plans.tables import SEC_CATS, intervals
    ev = events(spark, sf).select("event_id", "d")
    x = I.interval_max(ev, intervals(spark), "d", out="severity_max", cats=SEC_CATS)
    return _r(A.binned(x, "severity_max", _SEV))


@query("sign_counts", f"""WITH {PRED_CTE},
hard AS (SELECT * FROM pred ORDER BY abs(pred_slot - actual) DESC, event_id LIMIT 5)
SELECT CAST(count_if(pred_slot - actual < 0) AS BIGINT) AS n_under, CAST(count_if(pred_slot - actual > 0) AS BIGINT) AS n_over,
  (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type || ':' || n) FROM
     (SELECT event_type, count(*) AS n FROM hard GROUP BY event_type)) AS categories FROM hard""")
def q_sign_counts(spark, sf):
    p = predictions(spark, sf).withColumn("err", F.col("pred_slot") - F.col("actual"))
    return _r(A.sign_counts(p, "err", "event_type", "event_id", 5))


@query("metric_delta", f"""WITH {PRED_CTE},
mid AS (SELECT min(d) + CAST((max(d) - min(d)) / 2 AS INTEGER) AS m FROM pred),
a AS (SELECT model, avg(abs(pred - actual)) AS mae FROM plong WHERE d <= (SELECT m FROM mid) GROUP BY model),
b AS (SELECT model, avg(abs(pred - actual)) AS mae FROM plong WHERE d > (SELECT m FROM mid) GROUP BY model)
SELECT model, (a.mae) AS before, (b.mae) AS after, ((b.mae - a.mae) * 100.0 / a.mae) AS delta_pct
FROM a JOIN b USING (model)""")
def q_metric_delta(spark, sf):
    long = predictions_long(spark, sf)
    lo, hi = long.agg(F.min("d")).scalar(), long.agg(F.max("d")).scalar()
    mid = F.date_add(lo, F.floor(F.datediff(hi, lo) / 2).cast("int"))
    first = A.metrics(long.where(F.col("d") <= mid), "actual", "pred", by=["model"])
    second = A.metrics(long.where(F.col("d") > mid), "actual", "pred", by=["model"])
    return _r(A.metric_delta(first, second))


@query("usage_top_programs", f"""SELECT user_id, CAST(count(*) AS BIGINT) AS n, (avg(value)) AS mean FROM {EV}
GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 5""")
def q_usage_top_programs(spark, sf):
    """The five most used series (by row count) with their mean; a
    global top-k (per-partition top-k, then a merge)."""
    from ratecast.operators.topk import n_extreme
    g = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return _r(n_extreme(g, "n", 5, True, ["user_id"]))
