"""Window-operator queries (W1-W16, K7) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.operators import windows as W
from ratecast.plans.registry import query, measure
from ratecast.plans.tables import EV_ORDER, EVENTS_SQL, events, table

EV = EVENTS_SQL


def _em_sql(value: str, part: str, name: str) -> str:
    w = f"(PARTITION BY {part} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (f"CAST(count(*) OVER {w} AS BIGINT) AS {name}_n, "
            f"(CASE WHEN {value} IS NOT NULL AND count(*) OVER {w} > 0 THEN "
            f"coalesce(sum({value}) OVER {w}, 0) / count(*) OVER {w} END) AS {name}_mean")


@query("expanding_mean", f"SELECT event_id, user_id, {_em_sql('value', 'user_id', 'lag')} FROM {EV}")
def q_expanding_mean(spark, sf):
    ev = events(spark, sf)
    r = W.expanding_mean(ev, ["user_id"], "value", EV_ORDER, out="lag_mean", out_n="lag_n")
    return r.select("event_id", "user_id", F.col("lag_n").cast("bigint"), measure("lag_mean").alias("lag_mean"))


_KEYSETS = {"user": ["user_id"], "slot": ["dow", "h"], "status_hour": ["event_type", "h"]}


@query("lag_features", "SELECT event_id, " + ", ".join(
    _em_sql(t, ", ".join(ks), f"lag_{t}_{n}") for t in ("value", "k") for n, ks in _KEYSETS.items())
    + f" FROM {EV}")
def q_lag_features(spark, sf):
    ev = events(spark, sf)
    r = W.lag_features(ev, ["value", "k"], _KEYSETS, EV_ORDER)
    cols = ["event_id"]
    for t in ("value", "k"):
        for n in _KEYSETS:
            cols += [F.col(f"lag_{t}_{n}_n").cast("bigint"), measure(f"lag_{t}_{n}_mean").alias(f"lag_{t}_{n}_mean")]
    return r.select(*cols)


# W2 competitor part on lineitem: peers are the other line measures,
# slot = (returnflag, linestatus), order = (shipdate, orderkey, linenumber).
# (orderkey, linenumber) is not unique in the driver's lineitem; these nine
# columns are, so they form the total order.
_LI_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
             "l_quantity", "l_discount", "l_tax"]
_LI_ORDER_SQL = ", ".join(_LI_ORDER)
_PEERS = ["l_quantity", "l_discount", "l_tax"]


def _li_em_sql(value, name):
    w = (f"(PARTITION BY l_returnflag, l_linestatus ORDER BY {_LI_ORDER_SQL} "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return (f"CASE WHEN {value} IS NOT NULL AND count(*) OVER {w} > 0 THEN "
            f"coalesce(sum({value}) OVER {w}, 0) / count(*) OVER {w} END AS {name}")


@query("peer_lags", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"(lag_peer_{p}_mean) AS lag_peer_{p}_mean" for p in _PEERS)
    + ", ((" + " + ".join(f"coalesce(lag_peer_{p}_mean, 0)" for p in _PEERS) + ") / nullif("
    + " + ".join(f"CAST(lag_peer_{p}_mean IS NOT NULL AS INT)" for p in _PEERS) + ", 0)) AS lag_peers_avg"
    + " FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(_li_em_sql(p, f"lag_peer_{p}_mean") for p in _PEERS)
    + " FROM lineitem)")
def q_peer_lags(spark, sf):
    li = table(spark, sf, "lineitem")
    r = W.lag_features(li, [], {"slot": ["l_returnflag", "l_linestatus"]}, _LI_ORDER, peers=_PEERS)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[measure(f"lag_peer_{p}_mean").alias(f"lag_peer_{p}_mean")
                                                    for p in _PEERS], measure("lag_peers_avg").alias("lag_peers_avg"))


_WU = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("lags", f"SELECT event_id, lag(value, 1) OVER {_WU} AS lag_1, lag(value, 2) OVER {_WU} AS lag_2 FROM {EV}")
def q_lags(spark, sf):
    r = W.lags(events(spark, sf), ["user_id"], "value", EV_ORDER, ks=(1, 2))
    return r.select("event_id", "lag_1", "lag_2")


_WP = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("ema", f"SELECT event_id, (CASE WHEN count(*) OVER {_WP} > 0 THEN "
              f"list_reduce(list(value) OVER {_WP}, lambda a, x: a * 0.6 + x * 0.4) END) AS ema FROM {EV}")
def q_ema(spark, sf):
    r = W.ema(events(spark, sf), ["user_id"], "value", EV_ORDER, span=4)
    return r.select("event_id", measure("ema").alias("ema"))


@query("rolling_prev", "SELECT event_id, (avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
                       f"ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS rolling_mean FROM {EV}")
def q_rolling_prev(spark, sf):
    r = W.rolling_prev(events(spark, sf), ["user_id"], "value", EV_ORDER, n=4)
    return r.select("event_id", measure("rolling_mean").alias("rolling_mean"))


@query("weeks_since_start", "SELECT o_orderkey, CAST(floor(datediff('day', (SELECT min(CAST(o_orderdate AS DATE)) "
                            "FROM orders), CAST(o_orderdate AS DATE)) / 7) AS BIGINT) AS weeks_since_start FROM orders")
def q_weeks_since_start(spark, sf):
    o = table(spark, sf, "orders")
    return W.weeks_since_start(o, "o_orderdate").select("o_orderkey", "weeks_since_start")


@query("last_rows", "SELECT user_id, event_id, CAST(rn_desc AS BIGINT) AS rn_desc FROM (SELECT user_id, event_id, "
                    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn_desc "
                    f"FROM {EV}) WHERE rn_desc <= 3")
def q_last_rows(spark, sf):
    r = W.last_rows(events(spark, sf), ["user_id"], EV_ORDER, 3)
    return r.select("user_id", "event_id", F.col("rn_desc").cast("bigint"))


@query("dedupe_last", """
WITH u AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 0 AS version FROM orders
           UNION ALL
           SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 100.0, o_orderdate, o_orderpriority, 1
           FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(version AS BIGINT) AS version FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS rn FROM u) WHERE rn = 1""")
def q_dedupe_last(spark, sf):
    o = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    old = o.select(*cols, F.lit(0).cast("bigint").alias("version"))
    new = (o.where(F.col("o_orderstatus") == "O")
           .select(*[(F.col(c) + 100.0).alias(c) if c == "o_totalprice" else F.col(c) for c in cols],
                   F.lit(1).cast("bigint").alias("version")))
    r = W.dedupe(old.unionByName(new), ["o_orderkey"], ["version"], keep="last")
    return r.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "version")


_TREND_SQL = """
WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mth, avg(o_totalprice) AS mv FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY mth DESC) AS rn FROM m),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY mth) - 1 AS DOUBLE) AS i FROM r WHERE rn <= 7),
s AS (SELECT o_custkey, regr_slope(mv, i) AS sl, avg(mv) AS mn, count(*) AS k FROM l GROUP BY 1),
gm AS (SELECT date_trunc('month', o_orderdate) AS mth, avg(o_totalprice) AS mv FROM orders GROUP BY 1),
gl AS (SELECT *, CAST(row_number() OVER (ORDER BY mth) - 1 AS DOUBLE) AS i FROM (SELECT * FROM gm ORDER BY mth DESC LIMIT 7)),
g AS (SELECT CASE WHEN count(*) < 3 OR avg(mv) <= 0 THEN 0 ELSE greatest(least(regr_slope(mv, i) / avg(mv), 0.05), -0.05) END AS t FROM gl),
n AS (SELECT o_custkey, count(*) AS nrows FROM orders GROUP BY 1)
SELECT n.o_custkey, (CASE WHEN n.nrows < 5 THEN (SELECT t FROM g) WHEN s.k < 3 OR s.mn <= 0 THEN 0
       ELSE greatest(least(s.sl / s.mn, 0.05), -0.05) END) AS trend
FROM n JOIN s USING (o_custkey)"""


@query("trend_slope", _TREND_SQL)
def q_trend_slope(spark, sf):
    r = W.trend(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return r.select("o_custkey", measure("trend").alias("trend"))


@query("autocorr", f"""
WITH s AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value - avg(value) OVER (PARTITION BY user_id) AS x FROM {EV}),
k AS (SELECT CAST(range AS INTEGER) AS lag FROM range(1, 11))
SELECT k.lag, (corr(a.x, b.x)) AS acf, (1.96 / sqrt((SELECT count(x) FROM s))) AS band
FROM k JOIN s a ON true JOIN s b ON b.i = a.i + k.lag GROUP BY k.lag""")
def q_autocorr(spark, sf):
    ev = events(spark, sf).select(*EV_ORDER, "user_id", "value")
    means = ev.groupBy(F.col("user_id").alias("_u")).agg(F.avg("value").alias("_m"))
    ev = ev.join(means, F.col("user_id").eqNullSafe(F.col("_u")), "left").withColumn("x", F.col("value") - F.col("_m"))
    idx = W.global_index(ev.select(*EV_ORDER, "x"), EV_ORDER, out="i")
    r = W.autocorr(idx, "x", "i", lags=10)
    return r.select(F.col("lag").cast("int"), measure("acf").alias("acf"), measure("band").alias("band"))


@query("split_by_date", f"""
WITH c AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM {EV})
           WHERE i = CAST(round_even((SELECT count(*) - 1 FROM events) * 0.8, 0) AS BIGINT))
SELECT event_id, CASE WHEN d < (SELECT d FROM c) THEN 'train' ELSE 'test' END AS split FROM {EV}""")
def q_split_by_date(spark, sf):
    return W.split_by_date(events(spark, sf), "ts", 0.2).select("event_id", "split")


@query("split_by_row", f"""
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor((SELECT count(*) FROM events) * 0.8)
       THEN 'train' ELSE 'test' END AS split FROM {EV}""")
def q_split_by_row(spark, sf):
    return W.split_by_row(events(spark, sf).select(*EV_ORDER), EV_ORDER, 0.2).select("event_id", "split")


@query("time_folds", f"""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM {EV}),
n AS (SELECT count(*) AS n, floor(count(*) / 5) AS sz FROM events),
f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 5)),
x AS (SELECT r.event_id, f.fold, CASE WHEN r.i < n.n - 4 * n.sz + (f.fold - 1) * n.sz THEN 'train'
             WHEN r.i < n.n - 4 * n.sz + (f.fold - 1) * n.sz + n.sz THEN 'test' END AS role FROM r, n, f)
SELECT event_id, fold, role FROM x WHERE role IS NOT NULL""")
def q_time_folds(spark, sf):
    return W.time_folds(events(spark, sf).select(*EV_ORDER), EV_ORDER, k=4).select("event_id", "fold", "role")


@query("prefix", f"""
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM {EV})
WHERE rn <= floor((SELECT count(*) FROM events) * 0.3)""")
def q_prefix(spark, sf):
    return W.prefix(events(spark, sf).select(*EV_ORDER), EV_ORDER, 0.3).select("event_id")
