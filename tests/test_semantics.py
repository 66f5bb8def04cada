"""Semantic traps (survey §1.4) on small literal frames, checked against
pandas/numpy re-statements of the intended rule."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecast.functions import scalars as S
from ratecast.functions import text as X
from ratecast.operators import aggregates as A
from ratecast.operators import intervals as I
from ratecast.operators import stats as ST
from ratecast.operators import topk as K
from ratecast.operators import windows as W


def _ev(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, ts timestamp, v double")


def _ts(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def test_t1_expanding_mean_counts_nulls(spark):
    rows = [(1, "a", _ts(1), 1.0), (2, "a", _ts(2), None), (3, "a", _ts(3), 3.0), (4, "a", _ts(4), 5.0)]
    df = _ev(spark, rows)
    for rows_per_piece in (W.KEY_ROWS, 1):
        r = {x.id: (x.lag_n, x.lag_mean) for x in
             W.expanding_mean(df, ["k"], "v", ["ts", "id"], rows_per_piece=rows_per_piece).collect()}
        # pandas: (cumsum - v) / cumcount with nulls counted, null current -> null
        assert r[1] == (0, None)
        assert r[2][1] is None
        assert r[3] == (2, 0.5)
        assert abs(r[4][1] - 4.0 / 3.0) < 1e-12


def test_running_totals_in_pieces_equal_plain_for_hot_key(spark):
    rng = np.random.default_rng(1)
    n = 3000
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["b", "c", "d"], n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys,
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 30 * 86400, n), unit="s"),
                        "v": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    a = W.expanding_mean(df, ["k"], "v", ["ts", "id"]).select("id", "lag_mean", "lag_n")
    b = W.expanding_mean(df, ["k"], "v", ["ts", "id"], rows_per_piece=200).select("id", "lag_mean", "lag_n")
    pa = a.toPandas().sort_values("id").reset_index(drop=True)
    pb = b.toPandas().sort_values("id").reset_index(drop=True)
    assert (pa["lag_n"] == pb["lag_n"]).all()
    assert np.allclose(pa["lag_mean"].fillna(0), pb["lag_mean"].fillna(0))


def test_t3_date_cut_nearest_quantile(spark):
    days = [1, 1, 2, 3, 3, 3, 4, 5, 6, 7]
    df = _ev(spark, [(i, "a", _ts(d), 1.0) for i, d in enumerate(days)])
    out = W.split_by_date(df, "ts", 0.2).groupBy("split").agg(F.max(F.to_date("ts")).alias("mx"),
                                                              F.min(F.to_date("ts")).alias("mn"))
    res = {r.split: r for r in out.collect()}
    cut = sorted(days)[int(np.rint((len(days) - 1) * 0.8))]
    assert res["test"].mn == dt.date(2024, 1, cut)
    assert res["train"].mx < res["test"].mn


def test_t28_t29_ema_and_rolling_match_pandas(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = _ev(spark, [(i, "a", _ts(i + 1), v) for i, v in enumerate(vals)])
    r = W.rolling_prev(W.ema(df, ["k"], "v", ["ts", "id"]), ["k"], "v", ["ts", "id"]).orderBy("id").toPandas()
    s = pd.Series(vals).shift(1)
    exp_ema = s.ewm(span=4, adjust=False).mean()
    exp_roll = s.rolling(4, min_periods=1).mean()
    assert np.allclose(r["ema"].fillna(-1), exp_ema.fillna(-1))
    assert np.allclose(r["rolling_mean"].fillna(-1), exp_roll.fillna(-1))


def test_t6_t9_hours_and_dayparts(spark):
    df = spark.createDataFrame([("19:50:00",), ("25:10:30",), ("24:00:00",), ("bad",), (None,), ("03:00:00",)], "t string")
    r = df.select(S.hour_of("t", "floor").alias("f"), S.hour_of("t", "strict").alias("s"),
                  S.hour_of("t", "mod24").alias("m"), S.daypart(S.hour_of("t", "floor")).alias("dp")).collect()
    assert [x.f for x in r] == [19, 25, 24, 20, 20, 3]
    assert [x.s for x in r] == [19, 20, 20, 20, 20, 3]
    assert [x.m for x in r] == [19, 1, 0, 20, 20, 3]
    assert r[1].dp == S.DAYPART_LABELS[4] and r[5].dp == S.DAYPART_LABELS[5] and r[0].dp == S.DAYPART_LABELS[3]


def test_f1_minutes_over_24h(spark):
    df = spark.createDataFrame([("25:10:30",), ("00:27:00",), ("x:1:2",)], "t string")
    assert [r.m for r in df.select(S.hms_to_minutes("t").alias("m")).collect()] == [1510.5, 27.0, None]


def test_t16_t19_interval_tags(spark):
    iv = spark.createDataFrame([
        (1, "season", "s1", dt.date(2024, 1, 1), dt.date(2024, 1, 10), None),
        (2, "season", "s2", dt.date(2024, 1, 5), dt.date(2024, 1, 20), None),
        (3, "security", "b", dt.date(2024, 1, 3), dt.date(2024, 1, 6), 5),
        (4, "security", "a", dt.date(2024, 1, 4), dt.date(2024, 1, 8), 7),
        (5, "security", "open", dt.date(2024, 1, 4), None, 9),
        (6, "holiday", "h", dt.date(2024, 1, 9), dt.date(2024, 1, 9), 1),
    ], "ord long, category string, name string, start_date date, end_date date, severity long")
    df = spark.createDataFrame([(d, dt.date(2024, 1, d)) for d in range(1, 12)], "id long, d date")
    t = I.tag_events(df, iv, "d", season=["season"], holiday=["holiday"], security=["security"])
    t = I.interval_max(t, iv, "d", cats=["security"])
    t = I.latest_active(t, iv, "d", cats=["security"])
    r = {x.id: x for x in t.collect()}
    assert t.count() == df.count()  # tagging never changes the row count
    assert r[4].tag_season == "s1" and r[6].tag_season == "s2"  # last in file order wins
    assert r[5].tag_security == "b + a"  # concatenated in file order
    assert r[9].special_event == "h" and r[5].special_event == "b + a" and r[11].special_event == "—"
    assert r[5].severity_max == 7 and r[11].severity_max == 0  # null-end interval skipped
    assert r[5].days_since_start == 1 and r[5].event_severity == 7  # latest-started active
    assert r[11].days_since_start is None and r[11].event_severity == 0


def test_j8_count_since_start(spark):
    iv = spark.createDataFrame([(1, "security", "x", dt.date(2024, 1, 3), dt.date(2024, 1, 6), 5)],
                               "ord long, category string, name string, start_date date, end_date date, severity long")
    rows = [(i, "u", dt.date(2024, 1, d)) for i, d in enumerate([1, 3, 3, 4, 6, 7])]
    df = spark.createDataFrame(rows, "id long, u string, d date")
    la = I.latest_active(df, iv, "d", cats=["security"])
    r = {x.id: x.n_since_start for x in I.count_since_start(la, ["u"], "d").collect()}
    assert r == {0: 0, 1: 2, 2: 2, 3: 3, 4: 4, 5: 0}


def test_t32_best_model_first_on_ties(spark):
    df = spark.createDataFrame([(1.0, 1.5, 0.5, 2.0)], "y double, a double, b double, c double")
    assert K.best_model(df, "y", ["a", "b", "c"]).first().best_model == "a"


def test_t31_viewers_banker_rounding(spark):
    df = spark.createDataFrame([(0.0001,), (0.00006,), (1.0,)], "r double")
    r = df.select(S.households("r").alias("h"), S.viewers("r").alias("v")).collect()
    assert [x.h for x in r] == [round(0.0001 * 25000), round(0.00006 * 25000), 25000]
    assert r[2].v == round(25000 * 2.3)


def test_f17_text_dates(spark):
    today = "2026-06-01"  # a Monday
    texts = ["מחר בערב", "היום", "05/06/26", "31/02/2026", "no date here", "שישי הקרוב"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = [x.d for x in df.select(X.text_date("t", today).alias("d")).collect()]
    assert r[0] == dt.date(2026, 6, 2) and r[1] == dt.date(2026, 6, 1)
    assert r[2] == dt.date(2026, 6, 5) and r[3] is None and r[4] is None
    assert r[5] == dt.date(2026, 6, 5)  # next Friday strictly after today


def test_f19_json_in_prose(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('the answer is {"a": 2} ok',), ("none",)], "t string")
    assert [x.a for x in df.select(X.json_field("t", "$.a").alias("a")).collect()] == ["1", "2", None]


def test_dedupe_keep_last_and_first(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k long, arr long, v string")
    last = {r.k: r.v for r in W.dedupe(df, ["k"], ["arr"], "last").collect()}
    first = {r.k: r.v for r in W.dedupe(df, ["k"], ["arr"], "first").collect()}
    assert last == {1: "y", 2: "z"} and first == {1: "x", 2: "z"}


def test_top_n_per_group_skew_safe(spark):
    rows = [(0 if i % 3 else 1, i, float(i % 97)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, id long, v double")
    got = W.top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, out="r").toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "id", "v"]).sort_values(["g", "v", "id"], ascending=[True, False, True])
    exp = pdf.groupby("g").head(5)
    assert sorted(got["id"]) == sorted(exp["id"])


def test_psi_ks_identical_samples(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=500)}))
    assert abs(ST.psi(df, df, ["x"]).first().psi) < 1e-12
    r = ST.ks(df, df, ["x"]).first()
    assert r.ks_stat == 0.0 and r.ks_p == 1.0


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=400), rng.normal(0.3, 1.2, size=300)
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    pa = np.histogram(a, edges)[0]
    pb = np.histogram(b, edges)[0]
    pa = pa / pa.sum() + 1e-6
    pb = pb / pb.sum() + 1e-6
    exp = float(np.sum((pb - pa) * np.log(pb / pa)))
    got = ST.psi(spark.createDataFrame(pd.DataFrame({"x": a})), spark.createDataFrame(pd.DataFrame({"x": b})), ["x"])
    assert abs(got.first().psi - exp) < 1e-9


def test_spearman_average_ranks(spark):
    x = [1.0, 2.0, 2.0, 3.0, 5.0, 4.0]
    y = [2.0, 1.0, 4.0, 3.0, 6.0, 5.0]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    exp = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert abs(ST.spearman_vs(df, "y", ["x"]).first().spearman - exp) < 1e-12


def test_norm_ppf_accuracy(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.9995]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.z for r in df.select(ST.norm_ppf(F.col("p")).alias("z")).collect()]
    from statistics import NormalDist
    for p, z in zip(ps, got):
        assert abs(z - NormalDist().inv_cdf(p)) < 1e-8


def test_histogram_last_bin_closed(spark):
    vals = [0.0, 1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.n for r in A.histogram(df, "v", 5).orderBy("bin").collect()]
    assert got == list(np.histogram(vals, bins=5)[0])


def test_poisson_weights_mean_one():
    t = ST.poisson1_thresholds()
    assert abs(t[0] - math.exp(-1)) < 1e-15 and t[-1] < 1.0


def test_isolation_forest_flags_outliers(spark):
    from ratecast.operators.anomaly import isolation_forest
    rng = np.random.default_rng(7)
    pts = rng.normal(size=(600, 2))
    pts[:6] = [[8, 8], [-9, 7], [10, -10], [-8, -8], [12, 0], [0, -11]]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "a": pts[:, 0], "b": pts[:, 1]}))
    s = isolation_forest(df, df, ["a", "b"], "id", trees=200, sample=128, contamination=0.02).toPandas()
    s = s.sort_values("anomaly_score", ascending=False)
    assert set(s["id"].head(4)) == {0, 1, 2, 3}  # the corner outliers rank first
    normal = s[s["id"] >= 6]["anomaly_score"]
    assert (s[s["id"] < 6]["anomaly_score"] > normal.quantile(0.95)).all()
    assert s["is_anomaly"].mean() < 0.05


def test_read_raw_csv_banner_and_required(spark, tmp_path):
    from ratecast.sources import io as IO
    p = tmp_path / "raw.csv"
    p.write_text("Report exported 2026-03-01\nprogram,air_date,rating\nNews,2026-02-28,0.44\nLate,2026-02-28,\n")
    schema = T.StructType([T.StructField("program", T.StringType()), T.StructField("air_date", T.DateType()),
                           T.StructField("rating", T.DoubleType())])
    df = IO.read_raw_csv(spark, str(p), schema, ["program", "air_date", "rating"], "program")
    rows = sorted(df.collect(), key=lambda r: r.program)
    assert [(r.program, r.rating) for r in rows] == [("Late", None), ("News", 0.44)]
    try:
        IO.read_raw_csv(spark, str(p), schema, ["program", "share"], "program")
        raise AssertionError("missing column not detected")
    except ValueError as e:
        assert "share" in str(e)


def test_raw_csv_records_may_hold_line_breaks_and_equal_the_header(spark, tmp_path):
    from ratecast.sources import io as IO
    banner, header = 'Report, made "today"', "program,air_date,rating"
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text(f'{banner}\n{header}\n"News\nat ""nine"", late",2026-02-28,0.44\n\n{header}\n')
    (folder / "b.csv").write_text(f"{banner}\n{header}\nLate,not a date,x\n{banner}\n")
    schema = T.StructType([T.StructField("program", T.StringType()), T.StructField("air_date", T.DateType()), T.StructField("rating", T.DoubleType())])
    got = sorted(tuple(r) for r in IO.read_raw_csv(spark, str(folder), schema, ["program", "rating"], "program").collect())
    # the second header of a.csv and the second banner of b.csv are data
    want = [("Late", None, None), ('News\nat "nine", late', dt.date(2026, 2, 28), 0.44), ("Report", None, None), ("program", None, None)]
    assert [r[0] for r in got] == [r[0] for r in want] and got[0] == want[0] and got[1] == want[1] and got[3] == want[3]
    plain = tmp_path / "plain.csv"
    plain.write_text(f"{header}\nNews,2026-02-28,0.5\n{header}\n")
    assert sorted(tuple(r) for r in IO.read_raw_csv(spark, str(plain), schema, ["program"], "program").collect()) == [
        ("News", dt.date(2026, 2, 28), 0.5), ("program", None, None)]


def test_feed_items_of_rss_rdf_and_broken_text(spark):
    today = dt.date(2026, 3, 1)
    item = "<item><title> {} </title><pubDate>{}</pubDate></item>"
    feeds = [
        "<rss><channel><title>feed</title>" + item.format("A &amp; B", "Tue, 05 Mar 2024 23:30:00 +0200") + "<item><title>   </title></item>"
        + "<item><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>" + "<item><title><![CDATA[x <y>]]></title></item>" + item.format("C", "soon") + "</channel></rss>",
        "<rdf><channel><title>t</title></channel>" + item.format("D", "7 Apr 2024 01:00:00") + item.format("E", "") + "</rdf>",
        "<rss><channel>" + item.format("F", "") + "<item>", "", None, "no xml", "<rss><channel></channel></rss>"]
    df = spark.createDataFrame(list(enumerate(feeds)), "i int, x string")
    got = {r.i: [tuple(x) for x in r.f or []] for r in df.select("i", X.feed_items("x", "2026-03-01").alias("f")).collect()}
    assert got == {0: [("A & B", dt.date(2024, 3, 5)), ("x <y>", today), ("C", today)], 1: [("D", dt.date(2024, 4, 7)), ("E", today)],
                   2: [], 3: [], 4: [], 5: [], 6: []}
    two = df.select(X.feed_items("x", "2026-03-01", limit=2).alias("f")).where("f is not null").first().f
    assert [x.title for x in two] == ["A & B", "x <y>"]


def test_hash_tells_keys_apart_that_differ_in_high_bits(spark):
    ids = sorted({5 + j * 2 ** 29 for j in range(50)} | {5 + j * 2 ** 32 for j in range(50)} | {-1, -(2 ** 40)})
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    h = [r.h for r in df.select(K.mix_hash(F.col("id"), 42).alias("h")).collect()]
    assert len(set(h)) == len(ids) and min(h) >= 0
    from ratecast.operators import stats as ST
    words = df.select(*[w.alias(n) for w, n in zip(ST.hash_words(F.col("id"), 42), "ab")]).toPandas().to_numpy().astype(np.uint64)
    w = ST.replicate_weights(words[:, 0], words[:, 1], 4000, 42)
    assert len({tuple(r) for r in w}) == len(ids) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03


def test_dedupe_has_no_sort_aggregate(spark):
    df = spark.createDataFrame([(1, "a", None, 2), (1, "b", 5, 1), (1, "c", 5, 3), (None, "d", 1, 1), (None, "e", None, 9)], "k int, s string, a int, i int")
    for keep, want in (("last", {(1, "c"), (None, "d")}), ("first", {(1, "a"), (None, "e")})):
        r = W.dedupe(df, ["k"], ["a", "i"], keep)
        assert {(x.k, x.s) for x in r.collect()} == want
        plan = r._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_column_profile_edge_columns(spark):
    rows = [(1.0, "x", True, None), (-0.0, "y", None, None), (0.0, "y", False, None), (None, None, True, None)]
    got = {r.column: r for r in A.column_profile(spark.createDataFrame(rows, "v double, s string, b boolean, n int")).collect()}
    v, s, b, n = (got[c] for c in "vsbn")
    assert (v.n_unique, v.n_missing, v.min, v.median, v.max) == (2, 1, 0.0, 0.0, 1.0) and abs(v.std - np.std([1, 0, 0], ddof=1)) < 1e-12
    assert (s.n_unique, s.n_missing, s.top_values, s.mean) == (2, 1, "y (2), x (1)", None)
    assert (b.n_unique, round(b.true_share, 6)) == (2, round(2 / 3, 6)) and (n.n_unique, n.n_missing, n.median) == (0, 4, None)


def test_isolation_forest_draws_bounded_samples(spark):
    from ratecast.operators import anomaly as AN
    rows = spark.range(40_000).select(F.col("id").alias("_id"))
    drawn = AN.draw_trees(rows, 40_000, "_id", 50, 64, 42).groupBy("_tree").agg(F.count("*").alias("n"), F.countDistinct("_id").alias("u")).collect()
    assert sorted(r._tree for r in drawn) == list(range(50))
    assert all(r.n == r.u and 100 < r.n < 300 for r in drawn) and abs(np.mean([r.n for r in drawn]) - 192) < 10
    few = AN.draw_trees(rows.limit(20), 20, "_id", 5, 64, 42)
    assert few.count() == 100


def test_constraint_report_counts(spark):
    from ratecast.sources import io as IO
    parent = spark.createDataFrame([(1,), (2,)], "pk long")
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "z"), (None, 2, "a")], "k long, fk long, e string")
    r = {x.constraint: x.n_violations for x in IO.constraint_report(
        df, "t", not_null=["k"], unique=[["k"]], enums={"e": ["a"]}, fks=[("fk", parent, "pk")]).collect()}
    assert r == {"t.k not null": 1, "t(k) unique": 1, "t.e in enum": 1, "t.fk -> parent": 1}


def test_save_model_and_run_log(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from ratecast.operators.models import preprocessor
    from ratecast.sources import io as IO
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "a")], "x double, c string")
    pm = preprocessor(["x"], [], ["c"]).fit(df)
    IO.save_model(pm, {"version": 1}, str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m" / "model"))
    assert back.transform(df).select("features").count() == 3
    IO.append_run_log(spark, {"mae": 0.3}, str(tmp_path / "log"))
    IO.append_run_log(spark, {"mae": 0.29}, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2


def test_halo_windows_equal_plain_windows_on_hot_key(spark):
    rng = np.random.default_rng(11)
    n = 4000
    keys = np.where(rng.random(n) < 0.7, "hot", rng.choice(["b", "c"], n))
    # a few days with very few rows, so halos must reach back over several chunks
    days = np.where(rng.random(n) < 0.97, rng.integers(0, 10, n), rng.integers(10, 40, n))
    pdf = pd.DataFrame({"id": np.arange(n), "k": keys,
                        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(days * 86400 + rng.integers(0, 86400, n), unit="s"),
                        "v": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    order = ["ts", "id"]
    plain = W.rolling_prev(W.ema(W.lags(df, ["k"], "v", order, (1, 2, 5)), ["k"], "v", order), ["k"], "v", order)
    halo = W.rolling_prev(W.ema(W.lags(df, ["k"], "v", order, (1, 2, 5), rows_per_piece=60), ["k"], "v", order, rows_per_piece=60),
                          ["k"], "v", order, rows_per_piece=60)
    a = plain.toPandas().sort_values("id").reset_index(drop=True)
    b = halo.toPandas().sort_values("id").reset_index(drop=True)
    assert len(a) == len(b) == n
    for c in ["lag_1", "lag_2", "lag_5", "ema", "rolling_mean"]:
        assert np.allclose(a[c].fillna(-999), b[c].fillna(-999)), c


def test_asof_totals_equal_brute_force(spark):
    from ratecast.operators import pointintime as PT
    rng = np.random.default_rng(3)
    hist = pd.DataFrame({"k": rng.choice(["hot", "x"], 500, p=[0.9, 0.1]),
                         "d": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, 500), unit="D"),
                         "v": rng.normal(size=500)})
    req = pd.DataFrame({"request_id": np.arange(300), "k": rng.choice(["hot", "x", "new"], 300),
                        "target": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 45, 300), unit="D")})
    h, r = spark.createDataFrame(hist), spark.createDataFrame(req)
    asks = r.select("k", F.to_date("target").alias("_t")).distinct()
    got = {(x.k, x._t): x for x in PT.asof_totals(asks, PT.daily_totals(h, ["k"], "d", "v"), ["k"], 7).collect()}
    for k, t in zip(req.k, req.target):
        x, past = got[k, t.date()], hist[(hist.k == k) & (hist.d < t)]
        near = past[past.d >= t - pd.Timedelta(days=7)]
        assert (x.all_n, x.rec_n) == (len(past), len(near))
        assert abs(x.all_s - past.v.sum()) < 1e-9 and abs(x.rec_q - (near.v ** 2).sum()) < 1e-9


def test_point_in_time_falls_back_to_all_history(spark):
    """Fewer than ``min_rows`` rows in the look-back: the whole past counts; an empty key takes its mean."""
    from ratecast.operators import pointintime as PT
    hist = [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 3, 1), 5.0), (None, dt.date(2024, 3, 2), 9.0), ("b", dt.date(2024, 3, 3), None)]
    req = [(1, "a", dt.date(2024, 3, 5)), (2, "b", dt.date(2024, 3, 5)), (3, None, dt.date(2024, 3, 5)), (4, "a", dt.date(2023, 1, 1)), (5, "a", None)]
    h = spark.createDataFrame(hist, "k string, d date, v double")
    r = spark.createDataFrame(req, "request_id long, k string, target date")
    for min_rows, want in ((2, {1: (1, 5.0), 2: (0, 7.0), 3: (1, 9.0), 4: (0, None), 5: (0, None)}),
                           (3, {1: (2, 3.0), 2: (0, 5.0), 3: (1, 9.0), 4: (0, None), 5: (0, None)})):
        got = PT.point_in_time(r, h, {"k": (["k"], ["k"])}, "target", "d", "v", days=10, min_rows=min_rows).collect()
        assert {x.request_id: (x.lag_k_n, x.lag_k_mean) for x in got} == want


def test_count_since_start_equals_brute_force(spark):
    from ratecast.operators import intervals as I
    rng = np.random.default_rng(8)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=int(i))
    rows = [(i, "ab"[i % 2], day(rng.integers(0, 30)), None if i % 5 == 0 else day(rng.integers(-5, 32))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, d date, event_start date")
    got = I.count_since_start(df, ["k"], "d")
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        assert r.n_since_start == (0 if r.event_start is None else sum(k == r.k and r.event_start <= d <= r.d for _, k, d, _ in rows))


def test_null_keys_keep_their_history_across_chunks(spark):
    rows = [(None, day, i, float(10 * day + i)) for day in (1, 2, 3) for i in range(2)]
    df = spark.createDataFrame(rows, "k string, d int, i int, v double")
    for rows_per_piece in (W.KEY_ROWS, 2):
        r = W.expanding_mean(df, ["k"], "v", ["d", "i"], rows_per_piece=rows_per_piece).orderBy("d", "i").collect()
        assert [x.lag_n for x in r] == [0, 1, 2, 3, 4, 5]
        assert r[2].lag_mean == 10.5
        lag = W.lags(df, ["k"], "v", ["d", "i"], (1,), rows_per_piece=rows_per_piece).orderBy("d", "i").collect()
        assert [x.lag_1 for x in lag] == [None, 10.0, 11.0, 20.0, 21.0, 30.0]


def test_ema_of_a_long_span_is_the_full_recursion(spark):
    v = [float((i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame([(1, i, i // 50, x) for i, x in enumerate(v)], "k int, i int, c int, v double")
    e, want = v[0], [None]
    for x in v[1:]:
        want.append(e)
        e = e * (1 - 2 / 201) + x * 2 / 201
    for rows_per_piece in (W.KEY_ROWS, 70):
        got = [r.ema for r in W.ema(df, ["k"], "v", ["i"], span=200, rows_per_piece=rows_per_piece).orderBy("i").collect()]
        assert got[0] is None and all(abs(a - b) < 1e-9 for a, b in zip(got[1:], want[1:]))


def test_ema_scan_with_nulls_and_any_span(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[int(rng.random() < 0.2)], None if rng.random() < 0.3 else float(rng.normal(50, 20))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, k string, v double")
    for span in (1, 1.5, 3, 30):
        a, state, want = 2 / (span + 1), {}, {}
        for i, k, v in rows:
            before = state.get(k)
            if v is not None:
                state[k] = v if before is None else before * (1 - a) + v * a
            want[i] = (before, state.get(k))
        for rows_per_piece in (W.KEY_ROWS, 100):
            x = W.ema(df, ["k"], "v", ["i"], span=span, rows_per_piece=rows_per_piece)
            x = W.ema(x, ["k"], "v", ["i"], span=span, out="own", inclusive=True, rows_per_piece=rows_per_piece)
            for r in x.collect():
                for got, true in zip((r.ema, r.own), want[r.i]):
                    assert (got is None) == (true is None) and (true is None or abs(got - true) < 1e-9 * abs(true) + 1e-12)


def test_a_hot_key_and_day_is_cut(spark):
    """All rows in one key and one instant: no window task holds more than a piece."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id"), (F.col("id") % 7).cast("double").alias("v"))
    r = W.expanding_mean(df, ["k"], "v", ["ts", "id"], rows_per_piece=1000)
    lag = W.lags(df, ["k"], "v", ["ts", "id"], (1,), rows_per_piece=1000)
    ema = W.ema(df, ["k"], "v", ["ts", "id"], rows_per_piece=1000)
    light, heavy = W.split_heavy(df, ["k"], 1000)
    assert light.count() == 0
    pieces = W.key_pieces(heavy, ["k"], ["ts", "id"], 1000).groupBy("_piece").count().collect()
    assert sum(p["count"] for p in pieces) == 20_000 and max(p["count"] for p in pieces) <= 2000
    want, total, e = {}, 0.0, None
    for i in range(20_000):
        want[i] = (total / i if i else None, float((i - 1) % 7) if i else None, e)
        total += i % 7
        e = float(i % 7) if e is None else e * 0.6 + (i % 7) * 0.4
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert all(near(x.lag_mean, want[x.id][0]) and x.lag_n == x.id for x in r.collect())
    assert all(x.lag_1 == want[x.id][1] for x in lag.collect()) and all(near(x.ema, want[x.id][2]) for x in ema.collect())


def test_weekdays_sunday_first_and_confidence(spark):
    days = X.WEEKDAYS_HE
    texts = [f"{days[1]} {days[0]} {X.WORDS_NEXT[0]}", f"{X.PROGRAM_WORDS[0]} {X.WORD_TOMORROW}", f"{X.PROGRAM_WORDS[0]} 12/06/26", "12/06/26"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select(X.text_date("t", "2026-06-01").alias("d"), X.confidence("t", X.text_program("t")).alias("c")).collect()
    assert r[0].d == dt.date(2026, 6, 7)
    assert [x.c for x in r[1:]] == ["high", "medium", "low"]


def test_right_closed_and_open_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 10.5, 5000.0)], "v double")
    got = {r.bin: r.n for r in A.binned(df, "v", [0, 10, 50, None], right=True).collect()}
    assert got == {"0-10": 1, "10-50": 1, "50+": 1}


def test_ordered_pieces_split_one_hot_key(spark):
    # one key, one day, one value hold all rows: only the unique last column parts them
    from ratecast.operators.windows import ordered_pieces
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit("2024-01-01").alias("d"), F.col("id"))
    pieces = ordered_pieces(df, ["k", "d", "id"], rows_per_piece=1000).groupBy("_piece").agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("_pos").alias("p")).orderBy("_piece").collect()
    assert len(pieces) >= 15 and max(r.n for r in pieces) <= 2000 and sum(r.n for r in pieces) == 20_000
    assert all(a.hi < b.lo for a, b in zip(pieces, pieces[1:])) and all(r.p == r.n - 1 for r in pieces)


def test_global_index_counts_in_order(spark):
    rows = [(None, 7), (None, 1), (3, 2), (1, 9), (1, 4)]
    df = spark.createDataFrame(rows, "a long, id long")
    got = {(r.a, r.id): r.rn for r in W.global_index(df, ["a", "id"], rows_per_piece=2).collect()}
    assert got == {(None, 1): 1, (None, 7): 2, (1, 4): 3, (1, 9): 4, (3, 2): 5}
    assert W.global_index(df.limit(0), ["a", "id"]).count() == 0


def test_group_quantiles_match_numpy(spark):
    from ratecast.operators.quantiles import group_quantiles, quantiles, with_quantiles
    rng = np.random.default_rng(11)
    groups = {"a": rng.integers(0, 5, 301).astype(float), None: rng.normal(size=40), "one": np.array([2.5])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = {r.k: r.q for r in group_quantiles(df, ["k"], "v", qs, rows_per_piece=20).collect()}
    assert set(got) == {"a", None, "one"}
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, qs), rtol=1e-12)
    assert np.allclose(quantiles(df, "v", qs), np.quantile(np.concatenate(list(groups.values())), qs), rtol=1e-12)
    assert quantiles(df.where(F.col("k") == "nulls"), "v", qs) == [None] * 5
    med = {r.k: r.m for r in with_quantiles(df.groupBy("k").count(), df, ["k"], "v", {"m": 0.5}).collect()}
    assert med["nulls"] is None and med["one"] == 2.5 and np.isclose(med[None], np.median(groups[None]))


def test_spearman_with_nulls_ranks_each_pair(spark):
    pdf = pd.DataFrame({"y": [1.0, 2, 3, 4, 5, 6], "a": [2.0, 1, np.nan, 5, 4, 9], "b": [6.0, 5, 4, np.nan, np.nan, 1]})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "y double, a double, b double")
    got = {r.feature: r.spearman for r in ST.spearman_vs(df, "y", ["a", "b"]).collect()}
    exp = {c: pdf.loc[pdf[c].notna(), "y"].rank().corr(pdf[c].dropna().rank()) for c in ("a", "b")}
    assert set(got) == set(exp) and all(abs(got[c] - exp[c]) < 1e-12 for c in exp)


def test_series_baselines_are_one_step(spark):
    from ratecast.operators import models as M
    vals = [4.0, 8.0, 2.0, 6.0, 10.0]
    df = spark.createDataFrame([("s", i, v, "train" if i < 3 else "test") for i, v in enumerate(vals)], "k string, t long, v double, split string")
    got = {r.t: (r.pred_mean, r.pred_last, r.pred_ema) for r in M.series_baselines(df, ["k"], "v", ["t"], "split").collect()}
    e3 = (4 * 0.6 + 8 * 0.4) * 0.6 + 2 * 0.4
    assert set(got) == {3, 4}
    assert np.allclose(got[3], (2.0, 2.0, e3)) and np.allclose(got[4], (2.0, 6.0, e3 * 0.6 + 6 * 0.4))


def test_constraint_report_row_rule(spark):
    from ratecast.sources import io as IO
    df = spark.createDataFrame([(1, "x"), (None, "y"), (-5, "z")], "a long, b string")
    got = {r.constraint: r.n_violations for r in IO.constraint_report(df, "t", ["a"], enums={"b": ["x", "y"]}, checks={"a positive": F.col("a") > 0}).collect()}
    assert got == {"t.a not null": 1, "t.b in enum": 1, "t check a positive": 1}


def test_requests_take_events_only_when_asked(spark):
    from ratecast.operators import scoring as SC
    iv = spark.createDataFrame([(1, "security", "a", dt.date(2024, 1, 2), dt.date(2024, 1, 4), 1), (2, "holiday", "b", dt.date(2024, 1, 1), dt.date(2024, 1, 9), 1)],
                               "ord long, category string, name string, start_date date, end_date date, severity long")
    req = spark.createDataFrame([(1, dt.date(2024, 1, 3), "special_event"), (2, dt.date(2024, 1, 3), "routine"), (3, dt.date(2024, 1, 8), "special_event"),
                                 (4, dt.date(2024, 1, 3), None)], "id long, target date, scenario string")
    got = {r.id: (r.is_security, r.tag_security, r.scenario_effective) for r in SC.effective_scenario(req, iv, "target", "scenario", ["security"]).collect()}
    assert got == {1: (True, "a", "special_event"), 2: (False, "—", "routine"), 3: (False, "—", "routine"), 4: (False, "—", "routine")}


def test_answer_of_an_unknown_entity_takes_the_whole_trend(spark):
    from ratecast.operators import scoring as SC
    rows = [("s", dt.date(2024, m, 1), 10.0 + 0.1 * m, 1) for m in range(1, 9)]
    hist = spark.createDataFrame(rows, "e string, d date, v double, h long")
    req = spark.createDataFrame([("s", dt.date(2024, 8, 31), 10.0, 1), ("new", dt.date(2024, 8, 31), 10.0, 2), ("new", dt.date(2024, 7, 1), -1.0, 2)],
                                "e string, target date, raw_pred double, h long")
    got = SC.answer_fields(req, hist, entity="e", date="d", value="v", target="target", fine=["e", "h"], coarse=["h"]).orderBy("raw_pred", "n_hist").collect()
    slope = 0.1 / np.mean([10.0 + 0.1 * m for m in range(2, 9)])
    assert [r.n_hist for r in got] == [0, 0, 8] and [r.cold_start for r in got] == [True, True, False]
    assert got[0].predicted == 0.0 and got[0].low == 0.0
    assert all(abs(r.predicted - 10 * (1 + slope)) < 1e-9 for r in got[1:])
    assert got[1].unc_source == "default" and got[2].unc_source == "entity_slot"


def test_questions_without_a_date_ask_for_next_week(spark):
    from ratecast.operators import scoring as SC
    df = spark.createDataFrame([("קבינט",), ("hello",), ("קבינט מחר מלחמה",), (None,)], "q string")
    got = {r.q: (r.program, r.target, r.scenario, r.confidence) for r in SC.parse_questions(df, "q", "2026-06-01").collect()}
    week = dt.date(2026, 6, 8)
    assert got["קבינט"] == ("קבינט שישי", week, "routine", "medium") and got["hello"] == (None, week, "routine", "low")
    assert got["קבינט מחר מלחמה"] == ("קבינט שישי", dt.date(2026, 6, 2), "special_event", "high") and got[None] == (None, week, "routine", "low")


def test_refit_and_permutation_see_the_signal(spark):
    from ratecast.operators import models as M
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 4), float(i % 7), float((i * 5) % 11), 3.0 * (i % 7) + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, d date, a double, b double, y double")
    model, log = M.train_eval_refit(df, "y", "d", ["a", "b"], [], [], model="ridge", reg=0.0)
    one = log.first()
    assert one.n_rows == 200 and one.n_train + one.n_test == 200 and one.n_test > 0 and one.test_mae < 1e-6 and one.test_r2 > 0.999
    imp = {r.feature: (r.mae_increase, r["std"]) for r in M.permutation_importance(model, df, "y", ["a", "b"], "id", repeats=4).collect()}
    assert imp["a"][0] > 3 and abs(imp["b"][0]) < 1e-6
    grid = M.partial_dependence(model, df, ["a", "b"], 5).collect()
    assert len(grid) == 25 and all(abs(r.mean_pred - (3 * r.a + 1)) < 1e-6 for r in grid)


def test_except_keys_query_looks_at_every_order(spark, tmp_path):
    """a customer with only ordinary orders has an order."""
    from ratecast.plans.q_relational import q_except_keys
    spark.createDataFrame([(1, "urgent"), (2, "ordinary"), (3, "none")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, "5-LOW"), (None, "1-URGENT")], "o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [(r.c_custkey, r.c_name) for r in q_except_keys(spark, str(tmp_path)).collect()] == [(3, "none")]


def test_training_rows_are_dealt_in_whole_waves(spark):
    from ratecast.operators import models as M
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1000)
    assert [M.sized(df, r).rdd.getNumPartitions() for r in (1000, 250, 999 // cores, 1000 // (cores + 1))] == [cores, cores, 2 * cores, 2 * cores]


def test_learning_curve_sorts_only_what_it_uses(spark, monkeypatch):
    from ratecast.operators import models as M
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), "not used") for i in range(40)], "i long, a double, y double, tag string")
    seen, write = [], M.written
    monkeypatch.setattr(M, "written", lambda t, name: seen.append((name, t.columns)) or write(t, name))
    rows = M.learning_curve(df, df, "y", ["i"], ["a"], [], [], fracs=(1.0,), model="ridge", min_rows=1).collect()
    assert seen == [("indexed", ["i", "y", "a", "_rn"])] and rows[0]["n_train"] == 40
