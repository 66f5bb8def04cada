"""Top-k, set, projection/filter and join queries (K, U, P, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.operators import aggregates as A
from ratecast.operators import intervals as I
from ratecast.operators import joins as J
from ratecast.operators import projections as P
from ratecast.operators import setops as U
from ratecast.operators import topk as K
from ratecast.plans.predictions import MODELS, PRED_CTE, predictions, predictions_long
from ratecast.plans.q_aggregates import _r
from ratecast.plans.registry import query
from ratecast.plans.tables import EVENTS_SQL, INTERVALS_SQL, SEC_CATS, events, intervals, table

EV, IV = EVENTS_SQL, INTERVALS_SQL


# K1-K6 -------------------------------------------------------------------------
def _top_err_sql(mode):
    where = {"abs": "", "under": "WHERE actual - pred_slot > 0", "over": "WHERE actual - pred_slot < 0"}[mode]
    order = {"abs": "abs(actual - pred_slot) DESC", "under": "actual - pred_slot DESC",
             "over": "actual - pred_slot ASC"}[mode]
    return f"""WITH {PRED_CTE}
SELECT event_id, user_id, event_type, (actual) AS actual, (pred_slot) AS pred_slot,
  round(actual - pred_slot, 3) AS error, round(abs(actual - pred_slot), 3) AS abs_error
FROM pred {where} ORDER BY {order}, event_id LIMIT 20"""


def _top_err(mode):
    def fn(spark, sf):
        p = predictions(spark, sf).select("event_id", "user_id", "event_type", "actual", "pred_slot")
        return _r(K.top_errors(p, "actual", "pred_slot", 20, mode, tiebreak=["event_id"]))
    return fn


for _m in ("abs", "under", "over"):
    query(f"top_errors_{_m}", _top_err_sql(_m))(_top_err(_m))


@query("n_extreme", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def q_n_extreme(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return K.n_extreme(o, "o_totalprice", 25, True, ["o_orderkey"])


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("order_by_list", "SELECT o_orderpriority, CAST(CASE " + " ".join(
    f"WHEN o_orderpriority = '{v}' THEN {i + 1}" for i, v in enumerate(_PRIO[::-1]))
    + f" ELSE {len(_PRIO) + 1} END AS BIGINT) AS order_key, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def q_order_by_list(spark, sf):
    o = K.order_by_list(table(spark, sf, "orders"), "o_orderpriority", _PRIO[::-1])
    return o.groupBy("o_orderpriority", "order_key").agg(F.count("*").alias("n"))


@query("worst_per_model", f"""WITH {PRED_CTE},
seg AS (SELECT model, h, count(*) AS n, avg(abs(pred - actual)) AS mae FROM plong GROUP BY model, h HAVING count(*) >= 5)
SELECT model, h, CAST(n AS BIGINT) AS n, (mae) AS mae, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae DESC, h) AS rank FROM seg) WHERE rank <= 3""")
def q_worst_per_model(spark, sf):
    return _r(K.worst_per_model(predictions_long(spark, sf), "actual", "h", 3, 5), "rank")


@query("sample_n", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {K.mix_hash_sql('o_orderkey', 42)}, o_orderkey LIMIT 300")
def q_sample_n(spark, sf):
    return K.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 300, 42)


_PREDS = list(MODELS.values())


def _best_sql():
    names = list(MODELS)
    err = {m: f"abs({MODELS[m]} - actual)" for m in names}
    whens = []
    for i, m in enumerate(names):
        conds = [f"{err[m]} {'<' if j < i else '<='} {err[o]}" for j, o in enumerate(names) if o != m]
        whens.append(f"WHEN {' AND '.join(conds)} THEN '{m}'")
    return f"WITH {PRED_CTE} SELECT event_id, CASE {' '.join(whens)} END AS best_model FROM pred"


@query("best_model", _best_sql())
def q_best_model(spark, sf):
    p = K.best_model(predictions(spark, sf), "actual", _PREDS, list(MODELS))
    return p.select("event_id", "best_model")


# U1-U5 -------------------------------------------------------------------------
@query("union_merge", """WITH old AS (SELECT c_custkey, c_name, c_acctbal, 0 AS src FROM customer),
new AS (SELECT c_custkey, c_name, c_acctbal + 1000.0 AS c_acctbal, 1 AS src FROM customer WHERE c_mktsegment = 'BUILDING'),
u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT c_custkey, c_name, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY src DESC) AS rn FROM u)
WHERE rn = 1""")
def q_union_merge(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select("c_custkey", "c_name", "c_acctbal")
    new = (c.where(F.col("c_mktsegment") == "BUILDING")
           .select("c_custkey", "c_name", (F.col("c_acctbal") + 1000.0).alias("c_acctbal")))
    return U.union_merge(old, new, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def q_distinct_values(spark, sf):
    return U.distinct_values(table(spark, sf, "part"), "p_type")


@query("except_keys", """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
  WHERE o_custkey IS NOT NULL)""")
def q_except_keys(spark, sf):
    """Customers without any order."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return U.except_keys(c, o, ["c_custkey"])


@query("partition_by", """SELECT coalesce(o_totalprice > 200000, false) AS part, CAST(count(*) AS BIGINT) AS n,
  (sum(o_totalprice)) AS total FROM orders GROUP BY 1""")
def q_partition_by(spark, sf):
    hi, lo = U.partition_by(table(spark, sf, "orders"), F.col("o_totalprice") > 200000)
    a = hi.agg(F.lit(True).alias("part"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    b = lo.agg(F.lit(False).alias("part"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return _r(a.unionByName(b))


# P1-P14 ------------------------------------------------------------------------
@query("project", "SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_totalprice AS amount FROM orders")
def q_project(spark, sf):
    return P.project(table(spark, sf, "orders"), {"o_orderkey": "order_id", "o_orderdate": "order_date",
                                                  "o_totalprice": "amount"})


_DOC_LABELS = """(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _doc_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id", "left")


@query("drop_null", f"SELECT doc_id, lang, quality FROM {_DOC_LABELS} WHERE quality IS NOT NULL")
def q_drop_null(spark, sf):
    return P.drop_null(_doc_labels(spark, sf), ["quality"]).select("doc_id", "lang", "quality")


@query("filter_contains_eq", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(p_name, 'red') AND p_type = 'ECONOMY'")
def q_filter_contains_eq(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return P.filter_contains_eq(p, "p_name", "red", {"p_type": "ECONOMY"})


@query("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.filter_in(o, "o_orderpriority", ["1-URGENT", "2-HIGH"])


def _lookback_sql(days, min_rows):
    return f"""WITH t AS (SELECT max(d) AS t FROM {EV}),
n AS (SELECT count(*) AS n FROM {EV} e, t WHERE e.d < t.t AND e.d >= t.t - {days})
SELECT event_id FROM {EV} e, t, n WHERE e.d < t.t AND (e.d >= t.t - {days} OR n.n < {min_rows})"""


def _lookback(days, min_rows):
    def fn(spark, sf):
        ev = events(spark, sf)
        target = ev.agg(F.max("d")).scalar()
        return P.lookback(ev, "d", target, days, min_rows).select("event_id")
    return fn


query("lookback", _lookback_sql(7, 200))(_lookback(7, 200))
query("lookback_fallback", _lookback_sql(3, 2000))(_lookback(3, 2000))


@query("search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'und') AND role = 'user'")
def q_search(spark, sf):
    return P.search(table(spark, sf, "conversations"), "text", "UND", {"role": "user"}).select("conv_id", "turn")


_ORG = """(SELECT c_custkey AS user_id, c_nationkey AS organization_id FROM customer)"""


@query("tenant_rows", f"""SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_nationkey IN (SELECT organization_id FROM {_ORG} WHERE user_id = 1)""")
def q_tenant_rows(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    orgs = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"))
    return P.tenant_rows(o, "c_nationkey", orgs, 1).select("o_orderkey")


@query("tenant_visibility", """SELECT c.c_custkey AS user_id, CAST(coalesce(v.n, 0) AS BIGINT) AS n_visible, (v.total) AS total
FROM customer c LEFT JOIN (SELECT c2.c_nationkey AS org, count(*) AS n, sum(o.o_totalprice) AS total FROM orders o
  JOIN customer c2 ON o.o_custkey = c2.c_custkey GROUP BY 1) v ON v.org = c.c_nationkey""")
def q_tenant_visibility(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    orgs = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"))
    return _r(P.tenant_visibility(o, "c_nationkey", orgs, "o_totalprice"))


@query("tenant_insert_violations", f"""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
WHERE NOT EXISTS (SELECT 1 FROM {_ORG} u WHERE u.user_id = o.o_custkey AND u.organization_id = s.s_nationkey)""")
def q_tenant_insert_violations(spark, sf):
    """Rows 'inserted' by the ordering customer into the supplier's nation:
    a violation when the customer does not belong to that nation."""
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("org"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    li = (table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
          .join(o, "l_orderkey").join(s, "l_suppkey"))
    orgs = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"))
    return P.tenant_insert_violations(li, "org", "user_id", orgs).select("l_orderkey", "l_linenumber", "l_partkey",
                                                                         "l_suppkey")


@query("fill_constant", f"SELECT doc_id, CAST(coalesce(quality, -1) AS INTEGER) AS quality, "
                        f"CAST(coalesce(toxic, -1) AS INTEGER) AS toxic FROM {_DOC_LABELS}")
def q_fill_constant(spark, sf):
    return P.fill_constant(_doc_labels(spark, sf), ["quality", "toxic"], -1).select("doc_id", "quality", "toxic")


@query("median_impute", f"SELECT doc_id, (coalesce(CAST(quality AS DOUBLE), (SELECT median(CAST(quality AS DOUBLE)) "
                        f"FROM {_DOC_LABELS}))) AS quality FROM {_DOC_LABELS}")
def q_median_impute(spark, sf):
    return _r(P.median_impute(_doc_labels(spark, sf), ["quality"]).select("doc_id", "quality"))


@query("nan_to_null", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_discount = 0 THEN NULL
  ELSE l_tax / l_discount END) AS tax_ratio FROM lineitem""")
def q_nan_to_null(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.withColumn("tax_ratio", F.when(F.col("l_discount") == 0, F.lit(float("nan")))
                      .otherwise(F.col("l_tax") / F.col("l_discount")))
    x = P.nan_to_null(x, ["tax_ratio"])
    return _r(x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tax_ratio"))


@query("ensure_columns", """SELECT s_suppkey, s_name, s_acctbal, 'unknown' AS s_region, 0.0 AS s_rating FROM supplier""")
def q_ensure_columns(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return P.ensure_columns(s, {"s_acctbal": 0.0, "s_region": "unknown", "s_rating": 0.0})


@query("drop_leakage", f"WITH {PRED_CTE} SELECT event_id, user_id, event_type, d, h, dow FROM te")
def q_drop_leakage(spark, sf):
    from ratecast.plans.predictions import split_events
    t = split_events(spark, sf).where(F.col("split") == "test")
    return P.drop_leakage(t.select("event_id", "user_id", "event_type", "d", "h", "dow", "value", "k"), ["value", "k"])


@query("with_error", f"WITH {PRED_CTE} SELECT event_id, (pred_slot - actual) AS prediction_error FROM pred")
def q_with_error(spark, sf):
    return _r(P.with_error(predictions(spark, sf), "pred_slot", "actual").select("event_id", "prediction_error"))


@query("backfill_actuals", f"""WITH {PRED_CTE}
SELECT p.event_id, (coalesce(CASE WHEN p.event_type = 'view' THEN p.actual END, e.value)) AS actual
FROM pred p LEFT JOIN events e ON e.event_id = p.event_id""")
def q_backfill_actuals(spark, sf):
    p = predictions(spark, sf).withColumn("actual", F.when(F.col("event_type") == "view", F.col("actual")))
    a = table(spark, sf, "events").select("event_id", F.col("value").alias("actual"))
    return _r(P.backfill_actuals(p, a, ["event_id"]).select("event_id", "actual"))


# J1-J20 ------------------------------------------------------------------------
@query("lookup_inner", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey, o.o_orderdate
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_lookup_inner(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return J.lookup(li, o, "l_orderkey", "inner")


@query("lookup_left", """SELECT c.c_custkey, CAST(s.n AS BIGINT) AS n_orders, (s.total) AS total
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) s
ON c.c_custkey = s.o_custkey""")
def q_lookup_left(spark, sf):
    stats = (table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
             .agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")))
    return _r(J.lookup(table(spark, sf, "customer").select("c_custkey"), stats, "c_custkey", "left"))


@query("lookup_small", """SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_lookup_small(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return J.lookup(n, r, "n_regionkey", "inner", small=True).select("n_nationkey", "n_name", "r_name")


@query("unseen", """SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
  AND o.o_orderstatus = 'F')""")
def q_unseen(spark, sf):
    f = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return J.unseen(table(spark, sf, "customer").select("c_custkey"), f, ["c_custkey"])


@query("in_set", """SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN
  (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R')""")
def q_in_set(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    li = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.to_date("l_shipdate").alias("d"))
    return J.in_set(o, li, ["d"]).select("o_orderkey")


@query("apply_corrections", f"""WITH {PRED_CTE},
cells AS (SELECT event_type, dow, avg(actual - pred_slot) AS bias FROM pred GROUP BY event_type, dow
  HAVING count(*) >= 30 AND abs(avg(actual - pred_slot)) >= 0.1)
SELECT p.event_id, (p.pred_slot + CASE WHEN c.bias IS NULL THEN 0 ELSE greatest(least(c.bias, 0.3), -0.3) END) AS pred_corrected
FROM pred p LEFT JOIN cells c USING (event_type, dow)""")
def q_apply_corrections(spark, sf):
    p = predictions(spark, sf)
    cells = A.bias_cells(p, ["event_type", "dow"], "actual", "pred_slot")
    return _r(J.apply_corrections(p, cells, ["event_type", "dow"], "pred_slot").select("event_id", "pred_corrected"))


@query("align_series", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS ds, avg(o_totalprice) AS v FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS ds, avg(l_extendedprice) AS li_mean FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT a.ds, (a.v) AS v, (b.li_mean) AS li_mean FROM a LEFT JOIN b USING (ds)""")
def q_align_series(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.avg("o_totalprice").alias("v"))
    b = (table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
         .groupBy(F.to_date("l_shipdate").alias("ds")).agg(F.avg("l_extendedprice").alias("m")))
    return _r(J.align_series(a, b, "ds", "m", "li_mean"))


@query("recent_weekday_mean", f"WITH {PRED_CTE} SELECT event_id, (pred_weekday) AS pred_weekday FROM pred")
def q_recent_weekday_mean(spark, sf):
    return _r(predictions(spark, sf).select("event_id", "pred_weekday"))


@query("calendar_fill", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS ds, count(*) AS n FROM orders WHERE o_orderstatus = 'P'
  GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM c)
SELECT s.ds, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM s LEFT JOIN c USING (ds)""")
def q_calendar_fill(spark, sf):
    c = (table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
         .groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.count("*").alias("n")))
    return J.calendar_fill(c, "ds", "n")


@query("interpolate", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS ds, avg(o_totalprice) AS v FROM orders
  WHERE o_orderstatus = 'P' GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM c),
j AS (SELECT s.ds, c.v, c.ds AS kd FROM s LEFT JOIN c USING (ds)),
w AS (SELECT ds, v, last_value(CASE WHEN v IS NOT NULL THEN kd END IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pd,
  last_value(v IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN kd END IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd,
  first_value(v IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM j)
SELECT ds, (CASE WHEN v IS NOT NULL THEN v WHEN datediff('day', pd, nd) > 0 THEN
  pv + (nv - pv) * datediff('day', pd, ds) / datediff('day', pd, nd) END) AS v FROM w""")
def q_interpolate(spark, sf):
    c = (table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
         .groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.avg("o_totalprice").alias("v")))
    return _r(J.interpolate_daily(c, "ds", "v"))


_LEVELS = ["alert-north", "alert-south", "op-open", "election"]
_CONCAT = (f"coalesce((SELECT string_agg(i.name, ' + ' ORDER BY i.ord) FROM {IV} i WHERE i.category IN ('security', 'political') "
           f"AND i.end_date IS NOT NULL AND e.d BETWEEN i.start_date AND i.end_date), '—')")


@query("match_level", f"""WITH t AS (SELECT e.event_id, {_CONCAT} AS tag FROM {EV} e)
SELECT event_id, CASE WHEN tag IS NULL OR tag = '—' THEN '—' """ + " ".join(
    f"WHEN tag = '{lv}' THEN '{lv}'" for lv in _LEVELS) + " " + " ".join(
    f"WHEN contains('{lv}', tag) OR contains(tag, '{lv}') THEN '{lv}'" for lv in _LEVELS) + " ELSE '—' END AS level FROM t")
def q_match_level(spark, sf):
    ev = events(spark, sf).select("event_id", "d")
    t = I.interval_tag(ev, intervals(spark), "d", out="tag", mode="concat", cats=SEC_CATS)
    return J.match_level(t, "tag", _LEVELS).select("event_id", "level")


@query("count_mismatches", """WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE
  o_totalprice END AS o_totalprice, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders), j AS (SELECT a.*, b.o_totalprice AS b_p, b.o_orderpriority AS b_o, b.o_custkey AS b_c FROM orders a JOIN b USING (o_orderkey))
SELECT CAST(count(*) AS BIGINT) AS n_rows, 'o_custkey' AS column, CAST(sum(CASE WHEN o_custkey IS NOT DISTINCT FROM b_c THEN 0 ELSE 1 END) AS BIGINT) AS n_mismatch FROM j
UNION ALL SELECT CAST(count(*) AS BIGINT), 'o_totalprice', CAST(sum(CASE WHEN o_totalprice IS NOT DISTINCT FROM b_p THEN 0 ELSE 1 END) AS BIGINT) FROM j
UNION ALL SELECT CAST(count(*) AS BIGINT), 'o_orderpriority', CAST(sum(CASE WHEN o_orderpriority IS NOT DISTINCT FROM b_o THEN 0 ELSE 1 END) AS BIGINT) FROM j""")
def q_count_mismatches(spark, sf):
    a = table(spark, sf, "orders")
    b = a.select("o_orderkey", "o_custkey",
                 F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                 F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return J.count_mismatches(a, b, ["o_orderkey"], ["o_custkey", "o_totalprice", "o_orderpriority"])


@query("compare_preds", f"""WITH {PRED_CTE}
SELECT event_id, (abs(pred_slot - actual)) AS err_a, (abs(pred_user - actual)) AS err_b,
  CASE WHEN abs(abs(pred_slot - actual) - abs(pred_user - actual)) < 0.02 THEN 'tie'
       WHEN abs(pred_slot - actual) < abs(pred_user - actual) THEN 'a' ELSE 'b' END AS winner FROM pred""")
def q_compare_preds(spark, sf):
    p = J.compare_preds(predictions(spark, sf), "actual", "pred_slot", "pred_user", 0.02)
    return _r(p.select("event_id", "err_a", "err_b", "winner"))


@query("fallback_lookup", f"""WITH {PRED_CTE},
k0 AS (SELECT user_id, event_type, h, avg(value) AS m FROM tr GROUP BY ALL), k1 AS (SELECT user_id, event_type, avg(value) AS m FROM tr GROUP BY ALL)
SELECT te.event_id, (coalesce(k0.m, k1.m, (SELECT gm FROM gm))) AS pred,
  CAST(CASE WHEN k0.m IS NOT NULL THEN 0 WHEN k1.m IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS level
FROM te LEFT JOIN k0 USING (user_id, event_type, h) LEFT JOIN k1 USING (user_id, event_type)""")
def q_fallback_lookup(spark, sf):
    """Most specific seen level (series x type x hour, then series x
    type), else the global train mean; ``level`` says which one answered."""
    from ratecast.plans.predictions import split_events
    ev = split_events(spark, sf)
    tr, te = ev.where(F.col("split") == "train"), ev.where(F.col("split") == "test")
    r = J.cascade_mean(tr, te, [["user_id", "event_type", "h"], ["user_id", "event_type"]], "value", out="pred", level_out="level")
    return _r(r.select("event_id", "pred", F.col("level").cast("int")), "level")


@query("worst_entities_per_model", f"""WITH {PRED_CTE},
ent AS (SELECT model, user_id, count(*) AS n, avg(abs(pred - actual)) AS mae FROM plong GROUP BY model, user_id HAVING count(*) >= 5)
SELECT model, user_id, CAST(n AS BIGINT) AS n, (mae) AS mae, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae DESC, user_id) AS rank FROM ent) WHERE rank <= 5""")
def q_worst_entities_per_model(spark, sf):
    """K4 (entities): per model the 5 series with the highest MAE among
    those with at least 5 evaluated rows."""
    return _r(K.worst_per_model(predictions_long(spark, sf), "actual", "user_id", 5, 5), "rank")
