"""Model, serving-feature and scoring queries (W12-W14, M1, M4-M20, M25,
M27, M30-M32).  Model fits are checked rows-only (float tolerance); the
point-in-time features and series baselines have DuckDB oracles."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ratecast.functions import scalars as S
from ratecast.functions import text as X
from ratecast.operators import intervals as I
from ratecast.operators import models as M
from ratecast.operators import pointintime as PT
from ratecast.operators import scoring as SC
from ratecast.operators import windows as W
from ratecast.plans.predictions import PRED_CTE, split_events
from ratecast.plans.q_aggregates import _r
from ratecast.plans.registry import query
from ratecast.plans.tables import EV_ORDER, SEC_CATS, events, intervals, table
from ratecast.session import written

LABEL = "rating"
NUM = ["lag_rating_user_mean", "lag_rating_user_n", "lag_rating_slot_mean", "lag_rating_slot_n",
       "lag_rating_status_hour_mean", "lag_rating_status_hour_n", "lag_k_slot_mean", "h"]
BOOLS = ["is_holiday", "is_security"]
CATS = ["event_type"]
KEYSETS = {"user": ["user_id"], "status_hour": ["event_type", "h"], "slot": ["dow", "h"]}


def rated(ev):
    """The models' target: the logarithm of an event's value on a level of its
    series, raised in the evening and for purchases, so that history, hour
    and status tell something (``value`` alone is skewed noise)."""
    raised = F.when(F.col("h").between(18, 22), 2.0).otherwise(0.0) + F.when(F.col("event_type") == "purchase", 1.5).otherwise(0.0)
    return ev.withColumn(LABEL, F.log1p(F.greatest("value", F.lit(0.0))) + F.pmod("user_id", F.lit(5)) / 2 + raised)


def model_frame(spark, sf):
    """Tagged events with leakage-free history features; rows without any
    history of their own series are dropped; split by the date cut."""
    ev = rated(events(spark, sf))
    t = I.tag_events(ev, intervals(spark), "d", season=["season"], holiday=["holiday"], security=SEC_CATS)
    f = W.lag_features(t, [LABEL], KEYSETS, EV_ORDER, peers=["k"], peer_keyset="slot")
    f = f.drop("lag_peers_avg").withColumnRenamed("lag_peer_k_mean", "lag_k_slot_mean")
    f = f.where(F.col("lag_rating_user_mean").isNotNull())
    return W.split_by_date(f, "ts", 0.2)


def _parts(spark, sf, columns=()):
    """Train/test parts of the model frame, written once: every fit (medians,
    scaler, indexer, vectors) reads the columns it needs, and no memory is held.
    With ``columns``, only these travel through the frame's windows."""
    f = model_frame(spark, sf)
    f = written(f.select("split", *columns) if columns else f, "model_frame")
    return f.where(F.col("split") == "train"), f.where(F.col("split") == "test")


def _pipeline(train, model="gbt", cats=CATS):
    prep = M.preprocessor(NUM, BOOLS, cats).fit(train)
    return PipelineModel([prep, M.fit_vectors(M.make_model(model, LABEL), prep.transform(train))])


# M1, M4-M6, M12 ------------------------------------------------------------------
ALL_MODELS = ["ridge", "lasso", "elasticnet", "huber", "decision_tree", "random_forest", "gbt"]


@query("model_compare")
def q_model_compare(spark, sf):
    tr, te = _parts(spark, sf)
    metrics, _, _ = M.compare_models(tr, te, LABEL, "event_id", NUM, BOOLS, CATS, ALL_MODELS)
    return _r(metrics)


@query("feature_importance")
def q_feature_importance(spark, sf):
    tr, _ = _parts(spark, sf)
    pm = _pipeline(tr, "gbt")
    names = M.feature_names(pm.stages[0].transform(tr.limit(1)))
    rows = M.importance(pm.stages[-1], names)
    return spark.createDataFrame(rows, "feature string, importance double")


@query("conformal_interval")
def q_conformal_interval(spark, sf):
    tr, te = _parts(spark, sf)
    return _r(M.conformal_interval(tr, te, LABEL, "event_id", "ts", NUM, BOOLS, CATS, by=["event_type"]))


@query("learning_curve")
def q_learning_curve(spark, sf):
    tr, te = _parts(spark, sf)
    return _r(M.learning_curve(tr, te, LABEL, EV_ORDER, NUM, BOOLS, CATS))


@query("cluster_errors")
def q_cluster_errors(spark, sf):
    from ratecast.operators import aggregates as A
    tr, te = _parts(spark, sf)
    pm = _pipeline(tr, "gbt")
    scored = pm.transform(te).withColumn("err", F.col("prediction") - F.col(LABEL))
    cl = M.cluster_errors(scored, "features", "err", q=0.7, k=5)
    return _r(A.cluster_summary(cl, "cluster", {"security": F.col("is_security"), "over": F.col("err") > 0},
                                ["event_type"], {"abs_err": F.abs("err"), "bias": F.col("err"), "actual": F.col(LABEL)}))


@query("additive_daily")
def q_additive_daily(spark, sf):
    ev = I.tag_events(events(spark, sf), intervals(spark), "d", season=["season"], holiday=["holiday"],
                      security=SEC_CATS)
    # 18 months on, so that the days lie on the reception ramp
    ev = ev.withColumn("ds", F.add_months("d", 18))
    daily = ev.groupBy("ds").agg(F.avg("value").alias("v"), F.max(F.col("is_security").cast("double")).alias("security"),
                                 F.max(F.col("is_holiday").cast("double")).alias("holiday"))
    daily = (daily.withColumn("is_saturday", (F.dayofweek("ds") == 7).cast("double"))
             .withColumn("reception_pct", S.reception("ds", "daily").cast("double")))
    cut = W.date_cut(ev, "ds", 0.2)
    scored, coefs = M.fit_additive(daily, "ds", "v", ["holiday", "security", "is_saturday", "reception_pct"], cut)
    return _r(scored.select("ds", "v", "pred", "trend", "weekly", F.lit(coefs["weekly_amplitude"]).alias("weekly_amplitude")))


# M32 ---------------------------------------------------------------------------
_SERIES_W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SERIES_CTE = f"""{PRED_CTE},
h AS (SELECT event_id, user_id, d, value, count(*) OVER {_SERIES_W} AS seen, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l1,
      CASE WHEN count(*) OVER {_SERIES_W} > 0 THEN list_reduce(list(value) OVER {_SERIES_W}, lambda a, x: a * 0.6 + x * 0.4) END AS e FROM ev),
sm AS (SELECT user_id, avg(value) AS m FROM h WHERE seen >= 2 AND d < (SELECT cut FROM cutrow) GROUP BY user_id),
sb AS (SELECT h.event_id, h.value, sm.m AS pred_mean, coalesce(h.l1, sm.m) AS pred_last, coalesce(h.e, sm.m) AS pred_ema
       FROM h JOIN sm USING (user_id) WHERE h.seen >= 2 AND h.d >= (SELECT cut FROM cutrow))"""


def _series(spark, sf):
    return M.series_baselines(split_events(spark, sf), ["user_id"], "value", EV_ORDER, "split")


@query("series_baselines", f"WITH {_SERIES_CTE} SELECT event_id, pred_mean, pred_last, pred_ema FROM sb")
def q_series_baselines(spark, sf):
    return _r(_series(spark, sf).select("event_id", "pred_mean", "pred_last", "pred_ema"))


@query("series_baseline_scores", f"""WITH {_SERIES_CTE},
l AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS model, value, pred_{m} AS pred FROM sb" for m in ("mean", "last", "ema")) + """)
SELECT model, CAST(count(*) AS BIGINT) AS n, avg(abs(pred - value)) AS mae, sqrt(avg((pred - value) * (pred - value))) AS rmse,
  1 - sum((pred - value) * (pred - value)) / (var_pop(value) * count(*)) AS r2 FROM l GROUP BY model""")
def q_series_baseline_scores(spark, sf):
    """MAE, RMSE and R2 of the three baselines."""
    from ratecast.operators import aggregates as A
    long = A.to_long(_series(spark, sf), ["event_id", "value"], {m: f"pred_{m}" for m in ("mean", "last", "ema")})
    return _r(A.metrics(long, "value", "pred", by=["model"]))


@query("series_model_scores")
def q_series_model_scores(spark, sf):
    """The three baselines beside ridge and boosted trees fitted on the
    series' own history (previous value, EMA, history count) and the calendar."""
    from ratecast.operators import aggregates as A
    x = W.running_totals(split_events(spark, sf), ["user_id"], EV_ORDER, count_out="seen")
    x = W.lags(x, ["user_id"], "value", EV_ORDER, ks=(1,), prefix="lag")
    x = W.ema(x, ["user_id"], "value", EV_ORDER, span=4, out="ema_4").where(F.col("seen") >= 2)
    x = written(x.select("event_id", "value", "lag_1", "ema_4", "seen", "dow", "h", *CATS, "split"), "series_history")  # every fit reads it
    tr, te = x.where(F.col("split") == "train"), x.where(F.col("split") == "test")
    _, preds, _ = M.compare_models(tr, te, "value", "event_id", ["lag_1", "ema_4", "seen", "dow", "h"], [], CATS, ["ridge", "gbt"],
                                   {"ridge": {"reg": 1.0}, "gbt": {"depth": 3, "step": 0.05, "leaf": 5}})
    base = A.to_long(_series(spark, sf), ["event_id", "value"], {m: f"pred_{m}" for m in ("mean", "last", "ema")})
    both = preds.select("event_id", "value", "model", "pred").unionByName(base.select("event_id", "value", "model", "pred"))
    return _r(A.metrics(both, "value", "pred", by=["model"]))


@query("train_eval_refit")
def q_train_eval_refit(spark, sf):
    """Fit, evaluate, refit on all rows; the refitted model scores all rows."""
    f = written(model_frame(spark, sf).drop("split"), "model_frame")
    model, log = M.train_eval_refit(f, LABEL, "ts", NUM, BOOLS, CATS)
    refit = model.transform(f).agg(F.avg(F.abs(F.col("prediction") - F.col(LABEL)))).scalar()
    return _r(log.withColumn("refit_train_mae", refit))


# W12-W14 ---------------------------------------------------------------------------
_PIT_KEYS = {"prog": (["user_id"], ["user_id"]), "slot": (["dow", "h"], ["dow", "h"]),
             "status_hour": (["event_type", "h"], ["event_type", "h"])}


def _requests(spark, sf):
    ev = split_events(spark, sf)
    req = ev.where(F.col("split") == "test").select(F.col("event_id").alias("request_id"), "user_id",
                                                    F.col("d").alias("target"), "dow", "h", "event_type")
    return req, ev.where(F.col("split") == "train")


def _pit_sql(days, min_rows):
    win = f"tr.d < q.target AND (NOT q.recent OR tr.d >= q.target - {days})"
    parts = []
    for name, (rk, hk) in _PIT_KEYS.items():
        cond = " AND ".join(f"tr.{h} = q.{r}" for r, h in zip(rk, hk))
        parts.append(f"CAST((SELECT count(value) FROM tr WHERE {cond} AND {win}) AS BIGINT) AS lag_{name}_n")
        parts.append(f"(coalesce((SELECT avg(value) FROM tr WHERE {cond} AND {win}), "
                     f"(SELECT avg(value) FROM tr WHERE {win}))) AS lag_{name}_mean")
    return f"""WITH {PRED_CTE},
rq AS (SELECT event_id AS request_id, user_id, d AS target, dow, h, event_type FROM te),
q AS (SELECT rq.*, (SELECT count(*) FROM tr WHERE tr.d < rq.target AND tr.d >= rq.target - {days}) >= {min_rows} AS recent FROM rq)
SELECT request_id, {', '.join(parts)} FROM q"""


@query("point_in_time", _pit_sql(90, 200))
def q_point_in_time(spark, sf):
    req, hist = _requests(spark, sf)
    r = PT.point_in_time(req, hist, _PIT_KEYS, "target", "d", "value", days=90, min_rows=200)
    cols = ["request_id"] + [c for n in _PIT_KEYS for c in (f"lag_{n}_n", f"lag_{n}_mean")]
    return _r(r.select(*cols))


@query("series_features", f"""WITH {PRED_CTE},
s AS (SELECT user_id, list(value ORDER BY ts DESC, event_id DESC) AS rv, min(d) AS first_d, count(*) AS n FROM tr
      WHERE value IS NOT NULL GROUP BY user_id)
SELECT te.event_id AS request_id, (rv[1]) AS s_lag_1, (coalesce(rv[2], rv[1])) AS s_lag_2,
  (list_reduce(list_reverse(rv), lambda a, x: a * 0.6 + x * 0.4)) AS s_ema,
  (list_avg(rv[1:4])) AS s_roll4,
  CAST(floor(datediff('day', first_d, te.d) / 7) AS BIGINT) AS weeks_since_start, CAST(coalesce(n, 0) AS BIGINT) AS n_hist
FROM te LEFT JOIN s USING (user_id)""")
def q_series_features(spark, sf):
    req, hist = _requests(spark, sf)
    r = PT.series_features(req, hist, ["user_id"], "target", "d", "value", ["user_id", "ts", "event_id"])
    return _r(r.select("request_id", "s_lag_1", "s_lag_2", "s_ema", "s_roll4",
                       F.col("weeks_since_start").cast("bigint"), F.col("n_hist").cast("bigint")))


@query("uncertainty", f"""WITH {PRED_CTE},
f AS (SELECT user_id, event_type, count(value) AS fn, stddev_samp(value) AS fs FROM tr GROUP BY ALL),
c AS (SELECT event_type, dow, h, count(value) AS cn, stddev_samp(value) AS cs FROM tr GROUP BY ALL)
SELECT te.event_id AS request_id,
  (round(CASE WHEN coalesce(fn, 0) >= 5 THEN fs WHEN coalesce(cn, 0) >= 10 THEN cs ELSE 0.263 END * 1.28, 3)) AS half_width,
  CAST(CASE WHEN coalesce(fn, 0) >= 5 THEN fn WHEN coalesce(cn, 0) >= 10 THEN cn ELSE 0 END AS BIGINT) AS n_used,
  CASE WHEN coalesce(fn, 0) >= 5 THEN 'entity_slot' WHEN coalesce(cn, 0) >= 10 THEN 'slot' ELSE 'default' END AS unc_source
FROM te LEFT JOIN f USING (user_id, event_type) LEFT JOIN c USING (event_type, dow, h)""")
def q_uncertainty(spark, sf):
    req, hist = _requests(spark, sf)
    r = PT.uncertainty(req, hist, (["user_id", "event_type"],) * 2, (["event_type", "dow", "h"],) * 2, "value")
    return _r(r.select("request_id", "half_width", "n_used", "unc_source"))


# M30, M31 ------------------------------------------------------------------------
def score_requests(spark, sf, requests=None):
    """Batch scoring -- point-in-time features -> model -> trend
    scaling -> floor -> 80% range -> households/viewers -> label.
    ``requests`` has request_id, user_id, target, event_type, start and end
    (HH:MM) and scenario; by default the test events ask for themselves."""
    tr, _ = _parts(spark, sf, [LABEL, *NUM, *BOOLS, *CATS])
    pm = _pipeline(tr, "gbt")
    req, hist = _requests(spark, sf)
    hist = written(rated(hist), "history")
    if requests is None:
        requests = (req.withColumn("start", F.concat(F.lpad(F.col("h").cast("string"), 2, "0"), F.lit(":00")))
                    .withColumn("end", F.lit(None).cast("string")).withColumn("scenario", F.lit(SC.SPECIAL)))
    req = (requests.withColumn("h", F.substring("start", 1, 2).cast("bigint") % 24).withColumn("dow", F.dayofweek("target").cast("bigint"))
           .withColumn("duration", S.duration_wrap("start", "end").cast("bigint")))
    req = written(req, "requests")  # every keyset asks of it
    f = PT.point_in_time(req, hist, {"rating_user": (["user_id"],) * 2, "rating_slot": (["dow", "h"],) * 2,
                                     "rating_status_hour": (["event_type", "h"],) * 2, "k_slot": (["dow", "h"],) * 2},
                         "target", "d", LABEL, days=90, min_rows=200, values={"k_slot": "k"})
    f = I.tag_events(f, intervals(spark), "target", season=["season"], holiday=["holiday"], security=SEC_CATS)
    f = SC.effective_scenario(f.drop("is_security", "tag_security"), intervals(spark), "target", "scenario", SEC_CATS)
    scored = pm.transform(f).withColumnRenamed("prediction", "raw_pred")
    a = SC.answer_fields(scored, hist, entity="user_id", date="d", value=LABEL, target="target",
                         fine=["user_id", "dow", "h"], coarse=["dow", "h"])
    return a.select("request_id", "duration", "scenario_effective", *SC.ANSWER)


@query("score_requests")
def q_score_requests(spark, sf):
    return score_requests(spark, sf)


@query("answer_questions")
def q_answer_questions(spark, sf):
    """Parse every user turn into (date, program, scenario,
    confidence); questions naming a known series with a date become
    requests for the batch scorer."""
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    dt = X.text_date("text", "2026-06-01")
    prog = X.text_program("text")
    return c.select("conv_id", "turn", dt.alias("asked_date"), prog.alias("program"),
                    X.text_scenario("text").alias("scenario"), X.confidence("text", prog).alias("confidence"))


# M8-M11, M15-M19 ---------------------------------------------------------------------
@query("routed_experts")
def q_routed(spark, sf):
    from ratecast.operators import aggregates as A
    tr, te = _parts(spark, sf)
    p = M.routed(tr, te, "is_security", LABEL, NUM, BOOLS, CATS, min_rows=50)
    return _r(A.metrics(p, LABEL, "pred"))


@query("segment_experts")
def q_experts(spark, sf):
    tr, te = _parts(spark, sf)
    return _r(M.experts(tr, te, "event_type", LABEL, NUM, BOOLS, CATS, min_train=100, min_test=10))


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    tr, te = _parts(spark, sf)
    pm = _pipeline(tr, "gbt")
    return _r(M.permutation_importance(pm, te, LABEL, [*NUM, *BOOLS, *CATS], "event_id"))


@query("partial_dependence")
def q_partial_dependence(spark, sf):
    """Six features, one after another set to 40 values of their range."""
    tr, te = _parts(spark, sf)
    pm, out = _pipeline(tr, "gbt"), None
    for c in ["lag_rating_user_mean", "lag_rating_slot_mean", "lag_rating_status_hour_mean", "lag_rating_user_n", "lag_k_slot_mean", "h"]:
        one = M.partial_dependence(pm, te, c).select(F.lit(c).alias("feature"), "grid", F.col(c).cast("double").alias("at"), "mean_pred")
        out = one if out is None else out.unionByName(one)
    return _r(out)


@query("partial_dependence_2d")
def q_partial_dependence_2d(spark, sf):
    """The 25 x 25 grid over two features."""
    tr, te = _parts(spark, sf)
    return _r(M.partial_dependence(_pipeline(tr, "gbt"), te, ["lag_rating_user_mean", "lag_rating_slot_mean"]))


@query("counterfactual")
def q_counterfactual(spark, sf):
    tr, te = _parts(spark, sf)
    pm = _pipeline(tr, "gbt", [*CATS, "tag_security"])
    # train and test rows, since the calendar's events all lie before the cut
    return _r(M.counterfactual(pm, tr.unionByName(te), {"is_security": False, "tag_security": S.NO_TAG}, "tag_security", "event_id", LABEL,
                               F.col("is_security")))


@query("local_effects")
def q_local_effects(spark, sf):
    from ratecast.operators.topk import n_extreme
    tr, te = _parts(spark, sf)
    pm = _pipeline(tr, "gbt")
    worst = n_extreme(pm.transform(te).withColumn("abs_err", F.abs(F.col("prediction") - F.col(LABEL))),
                      "abs_err", 5, True, ["event_id"]).drop("features", "prediction", "abs_err")
    worst = worst.select(*[c for c in worst.columns if not c.startswith("_")])
    return _r(M.local_effects(pm, tr, worst, NUM, "event_id", 3).select("event_id", "feature", "contribution", "rank"),
              "rank")


@query("ablation")
def q_ablation(spark, sf):
    tr, te = _parts(spark, sf)
    cfg = {"full": (NUM, BOOLS, CATS), "no_flags": (NUM, [], CATS),
           "lags_only": (["lag_rating_user_mean", "lag_rating_slot_mean", "lag_rating_status_hour_mean"], [], [])}
    return _r(M.ablation(tr, te, LABEL, cfg))


@query("random_search")
def q_random_search(spark, sf):
    tr, _ = _parts(spark, sf)
    return _r(M.random_search(tr, LABEL, EV_ORDER, NUM, BOOLS, CATS,
                              {"trees": [10, 20, 40], "depth": [4, 6, 8], "leaf": [2, 5, 10], "features": ["sqrt", "0.5"]},
                              n_iter=2, k=4))


@query("stacking")
def q_stacking(spark, sf):
    from ratecast.operators import aggregates as A
    tr, te = _parts(spark, sf)
    p = M.stack(tr, te, LABEL, "event_id", EV_ORDER, NUM, BOOLS, CATS, k=3)
    return _r(A.metrics(p, LABEL, "pred"))


# M26 ---------------------------------------------------------------------------
@query("isolation_forest")
def q_isolation_forest(spark, sf):
    """Forest grown on train events (hour, weekday, second measure), test
    rows scored; baseline MAE on anomalies vs normal rows, and the Spearman
    correlation of the score with the absolute error."""
    from ratecast.operators.anomaly import isolation_forest
    from ratecast.operators.stats import spearman_vs
    from ratecast.plans.predictions import predictions
    cols = ["h", "dow", "k"]
    ev = split_events(spark, sf)
    tr = ev.where(F.col("split") == "train").select("event_id", *cols)
    te = predictions(spark, sf).join(ev.select("event_id", "k"), "event_id")
    scored = isolation_forest(tr, te, cols, "event_id", trees=200, sample=256, contamination=0.05)
    scored = scored.withColumn("abs_err", F.abs(F.col("pred_slot") - F.col("actual")))
    rho = spearman_vs(scored, "abs_err", ["anomaly_score"]).select("spearman").scalar()
    g = scored.groupBy("is_anomaly").agg(F.count("*").alias("n"), F.avg("abs_err").alias("mae"),
                                         F.avg("anomaly_score").alias("mean_score"))
    return _r(g.withColumn("spearman_score_abs_err", rho))


@query("embedding_anomalies")
def q_embedding_anomalies(spark, sf):
    """The same forest on the 64-float embedding vectors: anomaly share per label."""
    from ratecast.operators.anomaly import isolation_forest
    e = table(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    x = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    s = isolation_forest(x, x, cols, "vec_id", trees=200, sample=256, contamination=0.05)
    return _r(s.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_share"),
                                     F.avg("anomaly_score").alias("mean_score")))
