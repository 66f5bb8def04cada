"""Model operators on a target with a planted signal: what is learnt, who
wins and by how much, on frames small enough to fit in seconds."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecast.operators import aggregates as A
from ratecast.operators import models as M

NUM, BOOLS, CATS, ORDER = ["x1", "x2"], ["flag"], ["cat"], ["ts", "id"]
SHIFT = {"a": 0.0, "b": 5.0, "c": -5.0}
SLOPE = {"a": 3.0, "b": -3.0, "c": 0.5}


@pytest.fixture(scope="module")
def frame(spark):
    """y = 3 x1 + 8 flag + shift of cat + noise of deviation 0.5; ``bent`` has
    another slope for flagged rows, ``sloped`` another per cat."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        x1, x2, flag, cat = float(rng.uniform(0, 10)), float(rng.normal()), bool(rng.random() < 0.3), "abc"[int(rng.integers(3))]
        noise = float(rng.normal(0, 0.5))
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), x1, x2, flag, cat, 3 * x1 + 8 * flag + SHIFT[cat] + noise,
                     (-3 if flag else 3) * x1 + noise, SLOPE[cat] * x1 + noise))
    return spark.createDataFrame(rows, "id long, ts timestamp, x1 double, x2 double, flag boolean, cat string, y double, bent double, sloped double").cache()


@pytest.fixture(scope="module")
def parts(frame):
    return frame.where("id < 1200"), frame.where("id >= 1200")


@pytest.fixture(scope="module")
def boosted(parts):
    tr, _ = parts
    prep = M.preprocessor(NUM, BOOLS, CATS).fit(tr)
    from pyspark.ml import PipelineModel
    return PipelineModel([prep, M.fit_vectors(M.make_model("gbt", "y"), prep.transform(tr))])


def test_models_rank_as_the_signal_says(spark, parts):
    tr, te = parts
    names = ["ridge", "lasso", "elasticnet", "huber", "decision_tree", "random_forest", "gbt", "nope"]
    metrics, preds, secs = M.compare_models(tr, te, "y", "id", NUM, BOOLS, CATS, names)
    mae = {r["model"]: r["mae"] for r in metrics.collect()}
    mean = tr.agg(F.avg("y")).first()[0]
    constant = te.agg(F.avg(F.abs(F.col("y") - mean))).first()[0]
    assert secs["nope"] == "failed: KeyError" and set(mae) == set(names) - {"nope"}
    # the noise alone has a mean absolute error of 0.4
    assert all(mae[m] < 0.5 for m in ("ridge", "lasso", "elasticnet", "huber"))
    assert mae["ridge"] < mae["gbt"] < mae["decision_tree"] and mae["random_forest"] < 0.5 * constant
    assert all(r["n"] == 300 for r in metrics.collect()) and preds.count() == 7 * 300
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= 1  # this module's frame alone


def test_evaluate_then_refit_on_all(frame):
    model, log = M.train_eval_refit(frame, "y", "ts", NUM, BOOLS, CATS, model="ridge")
    r = log.first()
    assert r.n_rows == 1500 == r.n_train + r.n_test and 250 < r.n_test < 350 and r.test_mae < 0.5 and r.test_r2 > 0.98
    assert model.transform(frame).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.45


def test_conformal_interval_reaches_its_coverage(parts):
    r = M.conformal_interval(*parts, "y", "id", "ts", NUM, BOOLS, CATS, by=["cat"]).first()
    assert r.n == 300 and 0.72 < r.coverage_conformal < 0.97 and r.coverage_raw <= r.coverage_conformal and 0.8 < r.mean_width < 6


def test_learning_curve_falls(parts):
    rows = M.learning_curve(*parts, "y", ORDER, NUM, BOOLS, CATS, fracs=(0.05, 0.1, 0.5, 1.0), model="decision_tree").orderBy("frac").collect()
    assert [r.n_train for r in rows] == [120, 600, 1200] and rows[0].mae > rows[-1].mae  # 60 rows are too few


def test_importance_finds_the_signal(boosted, parts):
    names = M.feature_names(boosted.transform(parts[1]))
    found = dict(M.importance(boosted.stages[-1], names))
    assert len(names) == len(found) and abs(sum(found.values()) - 1) < 1e-6
    assert max(found, key=found.get) == names[0]  # x1
    rows = {r.feature: r for r in M.permutation_importance(boosted, parts[1], "y", [*NUM, *BOOLS, *CATS], "id", repeats=4).collect()}
    assert rows["x1"].mae_increase > rows["flag"].mae_increase > 0.5 and rows["cat"].mae_increase > 0.5
    assert abs(rows["x2"].mae_increase) < 0.2 and rows["x1"].std < rows["x1"].mae_increase


def test_partial_dependence_follows_the_slope(boosted, parts):
    rows = M.partial_dependence(boosted, parts[1], "x1").orderBy("grid").collect()
    assert len(rows) == 40 and abs((rows[35].mean_pred - rows[4].mean_pred) / (rows[35].x1 - rows[4].x1) - 3) < 0.4
    two = M.partial_dependence(boosted, parts[1], ["x1", "x2"], grid=5).collect()
    assert len(two) == 25
    by = {(r.grid, r.grid2): r.mean_pred for r in two}
    assert all(by[4, j] - by[0, j] > 20 for j in range(5)) and all(abs(by[i, 4] - by[i, 0]) < 3 for i in range(5))


def test_counterfactual_measures_the_flag(boosted, parts):
    rows = M.counterfactual(boosted, parts[1], {"flag": False}, "cat", "id", "y", F.col("flag")).collect()
    assert {r.cat for r in rows} == set("abc") and sum(r.n for r in rows) == parts[1].where("flag").count()
    assert all(abs(r.boost - 8) < 1.5 and r.max_boost >= r.boost and abs(r.pred_mean - r.pred_neutral_mean - r.boost) < 1e-9 for r in rows)


def test_local_effects_name_the_driving_column(boosted, parts):
    far = parts[1].where("x1 < 0.7 or x1 > 9.3")
    rows = M.local_effects(boosted, parts[0], far, NUM, "id", 2).collect()
    assert len(rows) == 2 * far.count() and all(r.feature == "x1" and abs(r.contribution) > 8 for r in rows if r["rank"] == 1)


def test_ablation_shows_what_each_column_gives(parts):
    got = {r.config: r.mae for r in M.ablation(*parts, "y", {"all": (NUM, BOOLS, CATS), "no flag": (NUM, [], CATS), "noise": (["x2"], [], [])}, "ridge").collect()}
    assert got["all"] < 0.5 < got["no flag"] < got["noise"]


def test_stacking_is_close_to_its_best_base(parts):
    r = A.metrics(M.stack(*parts, "y", "id", ORDER, NUM, BOOLS, CATS, bases=("ridge", "decision_tree"), k=2), "y", "pred").first()
    assert r.n == 300 and r.mae < 0.6


def test_routed_and_segment_experts_beat_one_model(parts):
    tr, te = parts
    one = M.preprocessor(NUM, BOOLS, CATS).fit(tr)
    plain = M.fit_vectors(M.make_model("ridge", "bent"), one.transform(tr)).transform(one.transform(te))
    plain = plain.agg(F.avg(F.abs(F.col("prediction") - F.col("bent")))).first()[0]
    routed = A.metrics(M.routed(tr, te, "flag", "bent", NUM, BOOLS, CATS, model="ridge"), "bent", "pred").first()
    assert routed.n == 300 and routed.mae < 0.5 < 5 < plain
    few = A.metrics(M.routed(tr, te, "flag", "bent", NUM, BOOLS, CATS, min_rows=10_000, model="ridge"), "bent", "pred").first()
    assert few.mae > 5  # too few flagged rows for an expert of their own
    rows = M.experts(tr, te, "cat", "sloped", NUM, BOOLS, [], model="ridge").orderBy("segment").collect()
    assert [r.segment for r in rows] == list("abc") and sum(r.n_train for r in rows) == 1200 and sum(r.n_test for r in rows) == 300
    assert all(r.mae_expert < 0.6 and abs(r.delta - (r.mae_expert - r.mae_central)) < 1e-9 for r in rows) and rows[1].gain_pct > 80
    assert M.experts(tr, te, "cat", "sloped", NUM, BOOLS, [], min_train=10_000, model="ridge").count() == 0


def test_random_search_prefers_the_deeper_tree(frame):
    rows = M.random_search(frame, "y", ORDER, NUM, BOOLS, CATS, {"depth": [1, 7]}, n_iter=6, k=2, model="decision_tree", at_once=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.params, set()).add(round(r.cv_mae, 9))
    assert len(rows) == 6 and len(by) == 2 and all(len(v) == 1 for v in by.values())
    assert min(by["[('depth', 7)]"]) < 0.5 * min(by["[('depth', 1)]"])


def test_clusters_of_large_errors(boosted, parts):
    scored = boosted.transform(parts[1]).withColumn("err", F.col("prediction") - F.col("y"))
    rows = M.cluster_errors(scored, "features", "err", q=0.7, k=3).collect()
    assert 85 <= len(rows) <= 95 and {r.cluster for r in rows} == {0, 1, 2}
    assert min(abs(r.err) for r in rows) >= sorted(abs(r.err) for r in scored.select("err").collect())[209]


def test_additive_model_recovers_its_parts(spark):
    rows = []
    for i in range(140):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=i)
        holiday = float(i % 17 == 0)
        rows.append((d, 10 + 0.2 * i + 4 * np.sin(2 * np.pi * i / 7) + 5 * holiday, holiday))
    daily = spark.createDataFrame([(d, float(v), h) for d, v, h in rows], "ds date, v double, holiday double")
    scored, coefs = M.fit_additive(daily, "ds", "v", ["holiday"], F.lit("2024-04-20").cast("date"))
    assert abs(coefs["holiday"] - 5) < 0.01 and abs(coefs["t"] - 0.2) < 0.001 and abs(coefs["weekly_amplitude"] - 4 / 2 ** 0.5) < 0.05
    assert scored.count() == 30 and scored.agg(F.max(F.abs(F.col("pred") - F.col("v")))).first()[0] < 0.05


def test_boosting_beats_slot_mean_beats_global_mean(spark):
    """The order of the published figures, on the table's events."""
    import bench
    _, secs, mae, n = bench.model_report(spark, "/root/testdata/sf0.01")
    assert n > 1000 and all(isinstance(s, float) for s in secs.values())
    assert mae["gbt"] < mae["slot_mean"] < mae["global_mean"]


def test_embedding_anomalies_grows_the_trees_of_the_source(spark, monkeypatch):
    from ratecast.operators import anomaly
    from ratecast.plans import q_models
    grown, whole = [], anomaly.isolation_forest
    monkeypatch.setattr(anomaly, "isolation_forest", lambda *a, trees, **kw: grown.append(trees) or whole(*a, trees=trees, **kw))
    assert q_models.q_embedding_anomalies(spark, "/root/testdata/sf0.001").count() and grown == [200]


def test_grids_and_permutations_prepare_each_row_once(boosted, parts, monkeypatch):
    """tree models are not run over grid x rows or repeats x columns x
    rows copies, and give what the copies give."""
    from pyspark.ml import PipelineModel
    te, cols = parts[1], [*NUM, "flag", "cat"]

    def run():
        grid = [M.partial_dependence(boosted, te, c, g).collect() for c, g in ((["x1", "x2"], 7), ("x1", 9))]
        drop = M.permutation_importance(boosted, te, "y", cols, "id", repeats=3).collect()
        return [{tuple(r[:-1]): r[-1] for r in rows} for rows in grid], {r[0]: tuple(r[1:]) for r in drop}
    real, sizes = PipelineModel.transform, []
    with monkeypatch.context() as m:
        m.setattr(PipelineModel, "transform", lambda self, df, *a: sizes.append(df.count()) or real(self, df, *a))
        grids, drops = run()
    assert max(sizes) <= te.count()
    with monkeypatch.context() as m:
        m.setattr(M, "tree_sum", lambda model: None)
        plain_grids, plain_drops = run()
    for got, want in zip(grids, plain_grids):
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert set(drops) == set(cols) and plain_drops["x1"][0] > 1
    assert all(abs(a - b) < 1e-9 for c in cols for a, b in zip(drops[c], plain_drops[c]))


def test_tree_sums_read_every_kind_of_tree(parts):
    """the read splits and leaves give the model's predictions."""
    from ratecast.operators.trees import tree_sum
    tr, te = parts
    prep = M.preprocessor(NUM, BOOLS, CATS).fit(tr)
    x = prep.transform(te).select("features")
    for name in ("decision_tree", "random_forest", "gbt"):
        m = M.make_model(name, "y").fit(prep.transform(tr).select("features", "y"))
        rows = m.transform(x).collect()
        forest = tree_sum(m)
        went = forest.outcomes(np.array([r.features.toArray() for r in rows]))
        assert np.allclose(sum(forest.predict(t, went) for t in forest.trees), [r.prediction for r in rows], atol=1e-9)
    assert tree_sum(M.make_model("ridge", "y").fit(prep.transform(tr).select("features", "y"))) is None


def test_bases_share_their_vectors(parts, monkeypatch):
    """a stack lays out each training part once for all its bases."""
    tr, te = parts
    real, laid = M.sized, []
    monkeypatch.setattr(M, "sized", lambda df, *a: laid.append(1) or real(df, *a))
    rows = M.stack(tr, te, "y", "id", ORDER, NUM, BOOLS, CATS, bases=("decision_tree", "ridge"), k=2).collect()
    assert len(laid) == 3 and len(rows) == te.count()


def test_explained_rows_are_found_once(spark, boosted, parts):
    """the variants do not each search again for the rows they change."""
    tr, te = parts
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = te.where("id < 1205").coalesce(1).mapInArrow(count, te.schema)
    got = M.local_effects(boosted, tr, rows, NUM, "id", 1).collect()
    assert seen.value == 5 and len(got) == 5 and all(r.feature == "x1" or abs(r.contribution) < 20 for r in got)


def test_series_models_read_their_history_once(spark, monkeypatch):
    """the windows run once, not again in every pass of every fit."""
    from ratecast.plans import q_models as Q

    class Stop(Exception):
        pass

    def look(tr, te, *a):
        assert all("Window" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (tr, te))
        assert tr.count() > 0 and te.count() > 0
        raise Stop
    monkeypatch.setattr(M, "compare_models", look)
    with pytest.raises(Stop):
        Q.q_series_model_scores(spark, "/root/testdata/sf0.001")


def test_forest_scores_leave_other_columns_alone(spark, monkeypatch):
    """F8: scores are those of a plain walk; rows are not turned into pandas."""
    import pandas as pd
    from pyspark.sql import DataFrame
    from ratecast.operators import anomaly as AN
    rng = np.random.default_rng(3)
    rows = [(i, dt.date(2024, 1, 1), float(rng.normal()), int(rng.integers(5))) for i in range(300)] + [(300, None, None, 2)]
    df = spark.createDataFrame(rows, "id long, day date, a double, b int")
    nodes = AN.fit_isolation_forest(df.where("id < 300"), ["a", "b"], "id", trees=7, sample=32)
    lone = pd.DataFrame([(7, 0, -1, 0.0, -1, -1, 2.5)], columns=nodes.columns)  # a tree of one leaf
    nodes = pd.concat([nodes, lone])
    monkeypatch.setattr(DataFrame, "mapInPandas", None)
    got = {r.id: r for r in AN.score_isolation_forest(df, nodes, ["a", "b"], 32).collect()}
    of = {(r.tree, r.node): r for r in nodes.itertuples()}
    for i, day, a, b in rows:
        total = 0.0
        for t in range(8):
            n = of[t, 0]
            while n.feature >= 0:
                v = (np.nan if a is None else a, b)[n.feature]
                n = of[t, n.left if v < n.threshold else n.right]
            total += n.path
        assert abs(got[i].anomaly_score - 2.0 ** (-total / 8 / AN._c(32))) < 1e-12 and got[i].day == day


def test_a_frame_of_the_used_columns_has_the_same_rows(spark):
    from ratecast.plans import q_models as Q
    used = [Q.LABEL, *Q.NUM, *Q.BOOLS, *Q.CATS]
    few, whole = Q._parts(spark, "/root/testdata/sf0.001", used)[0], Q._parts(spark, "/root/testdata/sf0.001")[0]
    assert few.columns == ["split", *used]
    assert sorted(map(str, few.select(*used).collect())) == sorted(map(str, whole.select(*used).collect()))


def test_scaled_columns_are_those_of_the_scaler(spark, parts):
    """rows are made into vectors once; the features are those that StandardScaler gives."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    tr, te = parts[0].withColumn("flat", F.lit(3)), parts[1].withColumn("flat", F.lit(4))
    num = [*NUM, "flat"]
    prep = M.preprocessor(num, BOOLS, CATS).fit(tr)
    assert sum(isinstance(s, VectorAssembler) for s in prep.stages) == 1
    vec = VectorAssembler(inputCols=num, outputCol="v")
    scaler = StandardScaler(inputCol="v", outputCol="w", withMean=True, withStd=True).fit(vec.transform(tr))
    both = scaler.transform(vec.transform(prep.transform(te))).collect()
    assert len(both) == 300 and all(np.array_equal(r.features.toArray()[:3], r.w.toArray()) and r.w[2] == 0 for r in both)
    assert M.feature_names(prep.transform(te))[:4] == ["_num_s_0", "_num_s_1", "_num_s_2", "_b_flag"]


def test_the_model_frame_windows_each_key_once(spark, monkeypatch):
    """the slot's means of both measures come from one pass over its rows."""
    from ratecast.operators import windows as W
    from ratecast.plans import q_models as Q
    sf, keys, real = "/root/testdata/sf0.001", [], W.running_totals
    with monkeypatch.context() as m:
        m.setattr(W, "running_totals", lambda df, ks, *a, **kw: keys.append(tuple(ks)) or real(df, ks, *a, **kw))
        got = {r.event_id: r.lag_k_slot_mean for r in Q.model_frame(spark, sf).collect()}
    assert len(keys) == len(set(keys)) == 3
    want = W.expanding_mean(Q.events(spark, sf), ["dow", "h"], "k", Q.EV_ORDER, out="m")
    want = {r.event_id: r.m for r in want.collect()}
    assert got and any(v is not None for v in got.values()) and all(want[e] == v for e, v in got.items())


def test_keysets_of_several_values_equal_calls_of_their_own(spark, monkeypatch):
    """keysets on the same columns join the requests once, whatever value they take."""
    from ratecast.operators import pointintime as PT
    rng = np.random.default_rng(5)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=int(i))
    hist = spark.createDataFrame([(int(rng.integers(4)) or None, day(rng.integers(60)), float(rng.normal()), float(rng.normal()) if rng.random() < 0.6 else None)
                                  for _ in range(400)], "a long, d date, v double, k double")
    req = spark.createDataFrame([(i, int(rng.integers(6)) or None, day(rng.integers(80))) for i in range(120)], "id long, a long, t date")
    one, two = (["a"], ["a"]), ([], [])
    apart = PT.point_in_time(req, hist, {"x": one, "z": two}, "t", "d", "v", days=20, min_rows=90)
    apart = PT.point_in_time(apart, hist, {"y": one}, "t", "d", "k", days=20, min_rows=90)
    joined, real = [], PT._match
    monkeypatch.setattr(PT, "_match", lambda left, *a: joined.append("id" in left.columns) or real(left, *a))
    together = PT.point_in_time(req, hist, {"x": one, "y": one, "z": two}, "t", "d", "v", days=20, min_rows=90, values={"y": "k"})
    assert sum(joined) == 2
    rows = [sorted(map(str, f.select("id", *[f"lag_{n}_{c}" for n in "xyz" for c in ("n", "mean")]).collect())) for f in (apart, together)]
    assert len(rows[0]) == 120 and rows[0] == rows[1]
