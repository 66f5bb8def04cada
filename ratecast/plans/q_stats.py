"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.operators import joins as J
from ratecast.operators import stats as ST
from ratecast.operators.topk import hash_words_sql
from ratecast.plans.predictions import PRED_CTE, predictions, split_events
from ratecast.plans.q_aggregates import _r
from ratecast.plans.registry import query
from ratecast.plans.tables import EVENTS_SQL, events

EV = EVENTS_SQL
_FEATS = ["value", "k", "h"]


def _long_sql(src):
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM {src}" for f in _FEATS)


_QS = ", ".join(repr(i / 10) for i in range(11))
_SIDES = f"""a AS ({_long_sql('tr')}), b AS ({_long_sql('te')}),
x AS (SELECT 'a' AS side, * FROM a WHERE v IS NOT NULL UNION ALL SELECT 'b', * FROM b WHERE v IS NOT NULL)"""


@query("psi", f"""WITH {PRED_CTE}, {_SIDES},
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{_QS}]))) AS edges FROM x WHERE side = 'a' GROUP BY feature),
sz AS (SELECT feature FROM x GROUP BY feature HAVING count_if(side = 'a') >= 50 AND count_if(side = 'b') >= 50),
ee AS (SELECT * FROM e JOIN sz USING (feature)),
xb AS (SELECT x.feature, x.side, least(len(list_filter(ee.edges, lambda z: z <= x.v)) - 1, len(ee.edges) - 2) AS bin
       FROM x JOIN ee USING (feature) WHERE x.v >= ee.edges[1] AND x.v <= ee.edges[len(ee.edges)]),
c AS (SELECT feature, bin, count_if(side = 'a') AS ca, count_if(side = 'b') AS cb FROM xb GROUP BY feature, bin),
sp AS (SELECT feature, unnest(range(0, len(edges) - 1)) AS bin FROM ee WHERE len(edges) >= 3),
f AS (SELECT sp.feature, sp.bin, coalesce(c.ca, 0) AS ca, coalesce(c.cb, 0) AS cb FROM sp LEFT JOIN c USING (feature, bin)),
p AS (SELECT feature, ca / sum(ca) OVER (PARTITION BY feature) + 1e-6 AS pa, cb / sum(cb) OVER (PARTITION BY feature) + 1e-6 AS pb FROM f)
SELECT feature, (sum((pb - pa) * ln(pb / pa))) AS psi FROM p GROUP BY feature
UNION ALL SELECT feature, 0.0 FROM ee WHERE len(edges) < 3""")
def q_psi(spark, sf):
    ev = split_events(spark, sf)
    tr, te = ev.where(F.col("split") == "train"), ev.where(F.col("split") == "test")
    return _r(ST.psi(tr, te, _FEATS))


def _ksp_sql(z):
    terms = " + ".join(f"{2.0 * (-1) ** (k - 1)!r} * exp({-2.0 * k * k!r} * {z} * {z})" for k in range(1, 101))
    return f"CASE WHEN {z} <= 0 THEN 1.0 ELSE greatest(least({terms}, 1.0), 0.0) END"


@query("ks", f"""WITH {PRED_CTE}, {_SIDES},
c AS (SELECT feature, v, CAST(count_if(side = 'a') AS DOUBLE) AS na, CAST(count_if(side = 'b') AS DOUBLE) AS nb FROM x GROUP BY feature, v),
cum AS (SELECT feature, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER (PARTITION BY feature) AS ta,
        sum(nb) OVER (PARTITION BY feature) AS tb FROM c
        WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, max(abs(ca / ta - cb / tb)) AS ks_stat, any_value(ta) AS ta, any_value(tb) AS tb FROM cum GROUP BY feature)
SELECT feature, (ks_stat) AS ks_stat, ({_ksp_sql('(sqrt(ta * tb / (ta + tb)) * ks_stat)')}) AS ks_p FROM d""")
def q_ks(spark, sf):
    ev = split_events(spark, sf)
    tr, te = ev.where(F.col("split") == "train"), ev.where(F.col("split") == "test")
    return _r(ST.ks(tr, te, _FEATS))


def _rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("spearman", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (corr(rc, rt)) AS spearman FROM (SELECT {_rank_sql(c)} AS rc, {_rank_sql('value')} AS rt "
    f"FROM {EV} WHERE {c} IS NOT NULL AND value IS NOT NULL)" for c in ("k", "h")))
def q_spearman(spark, sf):
    return _r(ST.spearman_vs(events(spark, sf), "value", ["k", "h"]))


_B = 1000
_U = "(CAST(xor(h, h >> 16) AS DOUBLE) / 4294967296.0)"
_W = "CASE " + " ".join(f"WHEN {_U} < {t!r} THEN {k}" for k, t in enumerate(ST.poisson1_thresholds())) + \
     f" ELSE {len(ST.poisson1_thresholds())} END"
_M32 = 1 << 32


def _rounds_sql(name, start, seed):
    """CTEs ``name``0 to 2: the rounds of the hash over ``start`` (an expression of a, b and rep, or of h)."""
    m0, m1, m2 = ST.HASH_MULTIPLIERS
    return f"""{name}0 AS (SELECT rep, e, b, (({start[1]}) * {m0} + {seed}) % {_M32} AS h FROM {start[0]}),
{name}1 AS (SELECT rep, e, b, (xor(h, h >> 15) * {m1}) % {_M32} AS h FROM {name}0),
{name}2 AS (SELECT rep, e, b, (xor(h, h >> 13) * {m2}) % {_M32} AS h FROM {name}1)"""


_A, _BW = hash_words_sql("event_id", 42)


@query("bootstrap_mae", f"""WITH {PRED_CTE},
words AS (SELECT {_A} AS a, {_BW} AS b, abs(pred_slot - actual) AS e FROM pred),
x AS (SELECT words.*, rep FROM words, range(1, {_B + 1}) t(rep)),
{_rounds_sql('f', ('x', f'(a + rep * {ST.COUNTER_STEP}) % {_M32}'), 42)},
{_rounds_sql('g', ('f2', 'xor(xor(h, h >> 16), b)'), 43)},
xw AS (SELECT rep, e, {_W} AS w FROM g2),
r AS (SELECT rep, sum(w * e) / sum(w) AS mae FROM xw GROUP BY rep)
SELECT (avg(mae)) AS boot_mean, (quantile_cont(mae, 0.025)) AS ci_low,
  (quantile_cont(mae, 0.975)) AS ci_high, (stddev_pop(mae)) AS std,
  ((SELECT avg(abs(pred_slot - actual)) FROM pred)) AS point FROM r""")
def q_bootstrap_mae(spark, sf):
    p = predictions(spark, sf).withColumn("err", F.col("pred_slot") - F.col("actual"))
    return _r(ST.bootstrap_mae(p, "err", "event_id", _B, 42))


@query("qq_points", f"""WITH {PRED_CTE}, r AS (SELECT pred_slot - actual AS v, event_id FROM pred),
o AS (SELECT row_number() OVER (ORDER BY v, event_id) AS i, v FROM r), n AS (SELECT count(*) AS n FROM r),
m AS (SELECT i, v, CASE WHEN i = 1 THEN 1 - pow(0.5, 1 / n) WHEN i = n THEN pow(0.5, 1 / n)
        ELSE (i - 0.3175) / (n + 0.365) END AS p FROM o, n)
SELECT CAST(i AS BIGINT) AS i, (v) AS sample, ({ST.norm_ppf_sql('p')}) AS theoretical FROM m""")
def q_qq_points(spark, sf):
    p = predictions(spark, sf).withColumn("resid", F.col("pred_slot") - F.col("actual"))
    return _r(ST.qq_points(p, "resid", "event_id"))


_DAILY = f"dly AS (SELECT d AS ds, avg(value) AS v FROM {EV} GROUP BY d)"
_DEC = f"""{_DAILY},
x AS (SELECT ds, v, CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END AS trend, dayofweek(ds) AS dw FROM dly
      WINDOW w AS (ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT dw, avg(v - trend) AS s FROM x GROUP BY dw), c AS (SELECT avg(s) AS c FROM s),
dec AS (SELECT ds, v AS observed, trend, s.s - c.c AS seasonal, v - trend - (s.s - c.c) AS resid FROM x JOIN s USING (dw), c)"""


def _daily(spark, sf):
    ev = events(spark, sf)
    d = ev.groupBy(F.col("d").alias("ds")).agg(F.avg("value").alias("v"))
    return J.interpolate_daily(d, "ds", "v")


@query("decompose_weekly", f"""WITH {_DEC} SELECT ds, (observed) AS observed, (trend) AS trend,
  (seasonal) AS seasonal, (resid) AS resid FROM dec""")
def q_decompose_weekly(spark, sf):
    return _r(ST.decompose_weekly(_daily(spark, sf), "ds", "v"))


@query("decompose_strength", f"""WITH {_DEC},
ok AS (SELECT * FROM dec WHERE resid IS NOT NULL),
amp AS (SELECT dayofweek(ds) AS dw, avg(seasonal) AS s FROM dec GROUP BY 1)
SELECT (1 - var_samp(resid) / var_samp(trend + resid)) AS trend_strength,
  (1 - var_samp(resid) / var_samp(seasonal + resid)) AS seasonal_strength,
  ((SELECT max(s) - min(s) FROM amp)) AS weekday_amplitude FROM ok""")
def q_decompose_strength(spark, sf):
    dec = ST.decompose_weekly(_daily(spark, sf), "ds", "v")
    return _r(ST.decomposition_strength(dec, "ds"))


@query("naive_daily", f"""WITH {PRED_CTE},
dly AS (SELECT d AS ds, avg(value) AS v, dayofweek(d) AS dw FROM ev GROUP BY d),
trd AS (SELECT * FROM dly WHERE ds < (SELECT cut FROM cutrow)), ted AS (SELECT * FROM dly WHERE ds >= (SELECT cut FROM cutrow)),
rec AS (SELECT * FROM trd WHERE ds >= (SELECT max(ds) FROM trd) - 56),
wkd AS (SELECT dw, avg(v) AS m FROM rec GROUP BY dw)
SELECT 'global' AS model, (avg(abs((SELECT avg(v) FROM trd) - v))) AS mae FROM ted
UNION ALL SELECT 'weekday', (avg(abs(coalesce(wkd.m, (SELECT avg(v) FROM trd)) - ted.v))) FROM ted LEFT JOIN wkd USING (dw)""")
def q_naive_daily(spark, sf):
    ev = split_events(spark, sf)
    d = ev.groupBy(F.col("d").alias("ds")).agg(F.avg("value").alias("v"), F.first("split").alias("split"))
    tr, te = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    g = tr.agg(F.avg("v")).scalar()
    wk = J.recent_weekday_mean(tr, te, "ds", "v", 8, out="p")
    a = te.agg(F.avg(F.abs(g - F.col("v"))).alias("mae")).withColumn("model", F.lit("global"))
    b = wk.agg(F.avg(F.abs(F.col("p") - F.col("v"))).alias("mae")).withColumn("model", F.lit("weekday"))
    return _r(a.unionByName(b).select("model", "mae"))


@query("calibration", f"""WITH {PRED_CTE}, p AS (SELECT round(pred_slot, 6) AS pr, actual FROM pred),
e AS (SELECT list_sort(list_distinct(quantile_cont(pr, [{', '.join(repr(i / 15) for i in range(16))}]))) AS edges FROM p),
b AS (SELECT CAST(greatest(len(list_filter(edges, lambda z: z < pr)), 1) AS INTEGER) AS bin, pr, actual FROM p, e),
g AS (SELECT bin, CAST(count(*) AS BIGINT) AS n, avg(pr) AS mean_pred, avg(actual) AS mean_actual, avg(actual) - avg(pr) AS gap FROM b GROUP BY bin)
SELECT *, bin = (SELECT arg_max(bin, abs(gap)) FROM g) AS is_max_gap FROM g""")
def q_calibration(spark, sf):
    """A36.  Predictions are rounded to six digits, so that equal ones are
    equal in every engine and each edge is one of them or clearly between."""
    p = predictions(spark, sf).withColumn("pred_slot", F.round("pred_slot", 6))
    return _r(ST.calibration(p, "actual", "pred_slot", 15))
