"""Source / sink queries (S1-S18).  Round trips write whole driver tables
(or results derived from them) under the shared checkpoint folder and
read them back, so their work grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecast.operators import aggregates as A
from ratecast.operators import intervals as I
from ratecast.operators import windows as W
from ratecast.plans.predictions import PRED_CTE, predictions
from ratecast.plans.q_aggregates import _r
from ratecast.plans.q_functions import _ST, _start_time
from ratecast.plans.registry import query
from ratecast.plans.tables import EVENTS_SQL, INTERVALS, INTERVALS_SQL, SEC_CATS, events, table
from ratecast.sources import io as IO

EV, IV = EVENTS_SQL, INTERVALS_SQL

_ORD_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                            T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
                            T.StructField("o_orderdate", T.TimestampNTZType())])


@query("csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def q_csv_roundtrip(spark, sf):
    cols = [f.name for f in _ORD_SCHEMA.fields]
    path = IO.write_artifact(table(spark, sf, "orders").select(*cols), IO.scratch_path(spark, "orders_csv"), "csv")
    return IO.read_raw_csv(spark, path, _ORD_SCHEMA, required=cols, header_key="o_orderkey")


@query("read_joined", """SELECT l.l_orderkey AS order_id, l.l_linenumber AS line, o.o_custkey AS customer,
  l.l_extendedprice AS price FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey IS NOT NULL""")
def q_read_joined(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return IO.read_joined(li, o, ["l_orderkey"], {"l_orderkey": "order_id", "l_linenumber": "line",
                                                  "o_custkey": "customer", "l_extendedprice": "price"}, ["o_custkey"])


_IV_SRC = {"ord": "ord", "kind": "category", "event": "name", "date_from": "start_date", "date_to": "end_date",
           "severity": "severity"}


@query("intervals_from_csv", f"""SELECT e.event_id, coalesce((SELECT string_agg(i.name, ' + ' ORDER BY i.ord) FROM {IV} i
  WHERE i.category IN ('security', 'political') AND i.end_date IS NOT NULL AND e.d BETWEEN i.start_date AND i.end_date), '—')
  AS tag_security FROM {EV} e""")
def q_intervals_from_csv(spark, sf):
    rows = [(str(o), c, n, s or "", e or "not-a-date", "" if v is None else str(v)) for o, c, n, s, e, v in INTERVALS]
    src = spark.createDataFrame(rows, "ord string, kind string, event string, date_from string, date_to string, "
                                      "severity string")
    path = IO.write_artifact(src, IO.scratch_path(spark, "intervals_csv"), "csv")
    iv = IO.read_intervals(spark, path, _IV_SRC)
    ev = events(spark, sf).select("event_id", "d")
    return I.interval_tag(ev, iv, "d", out="tag_security", mode="concat", cats=SEC_CATS).select("event_id", "tag_security")


@query("unpivot_blocks", """SELECT o_custkey, CAST((rn - 1) // 3 AS BIGINT) AS line, 'b' || ((rn - 1) % 3 + 1) AS kind, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS name
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)""")
def q_unpivot_blocks(spark, sf):
    """Every order of a customer in lines of three side-by-side (date, name)
    blocks, as many lines as they need, and back."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    nth = W.running_totals(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], count_out="nth")
    nth = nth.withColumn("line", F.floor(F.col("nth") / 3)).withColumn("block", F.col("nth") % 3)
    wide = nth.groupBy("o_custkey", "line").agg(
        *[F.max(F.when(F.col("block") == i, F.to_date("o_orderdate"))).alias(f"d{i + 1}") for i in range(3)],
        *[F.max(F.when(F.col("block") == i, F.col("o_orderpriority"))).alias(f"n{i + 1}") for i in range(3)])
    return IO.unpivot_blocks(wide, [(f"b{i}", f"d{i}", f"n{i}") for i in (1, 2, 3)], ids=["o_custkey", "line"])


@query("result_set", f"""SELECT 'by_type' AS name, event_type AS key, CAST(count(*) AS BIGINT) AS n, avg(value) AS mean FROM {EV} GROUP BY event_type
UNION ALL SELECT 'by_day', CAST(d AS VARCHAR), CAST(count(*) AS BIGINT), avg(value) FROM {EV} GROUP BY d""")
def q_result_set(spark, sf):
    """Two named results written as a set; every row is read back."""
    ev = events(spark, sf)
    res = {"by_type": A.profile(ev, ["event_type"], "value"), "by_day": A.profile(ev, ["d"], "value")}
    paths = IO.write_result_set(res, IO.scratch_path(spark, "results"))
    keys = {"by_type": "event_type", "by_day": "d"}
    parts = [spark.read.parquet(p).select(F.lit(n).alias("name"), F.col(keys[n]).cast("string").alias("key"), F.col("n").cast("bigint"), "mean") for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


def _star(spark, sf):
    ev = _start_time(events(spark, sf)).withColumn("program", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return IO.load_star(ev, "program", "event_type", "ts", "start_time", ["ts", "event_id"])


@query("load_star_programs", f"""SELECT 'user-' || user_id AS program, min(d) AS first_aired, max(d) AS last_aired,
  CAST(count(*) AS BIGINT) AS n_broadcasts, arg_min(event_type, (ts, event_id)) AS source_name, md5('user-' || user_id) AS id
FROM {EV} GROUP BY user_id""")
def q_load_star_programs(spark, sf):
    progs, _ = _star(spark, sf)
    return progs.select("program", "first_aired", "last_aired", "n_broadcasts", "source_name", "id")


@query("load_star_facts", f"""WITH x AS (SELECT *, md5('user-' || user_id) AS program_id,
  printf('%02d:%02d:%02d', CAST(split_part(start_time, ':', 1) AS INTEGER) % 24, CAST(split_part(start_time, ':', 2) AS INTEGER),
  CAST(split_part(start_time, ':', 3) AS INTEGER)) AS tod FROM (SELECT *, {_ST} FROM {EV}))
SELECT event_id, program_id FROM (SELECT *, row_number() OVER (PARTITION BY d, tod, program_id ORDER BY ts, event_id) AS rn FROM x)
WHERE rn = 1""")
def q_load_star_facts(spark, sf):
    _, facts = _star(spark, sf)
    return facts.select("event_id", "program_id")


@query("upsert_latest", """WITH u AS (SELECT c_custkey, c_acctbal, 0 AS version, 0 AS src FROM customer
  UNION ALL SELECT c_custkey, c_acctbal + 1, 1, 1 FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_custkey, c_acctbal + 2, 2, 1 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT c_custkey, c_acctbal, CAST(version AS BIGINT) AS version FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY version DESC, src DESC) AS rn FROM u) WHERE rn = 1""")
def q_upsert_latest(spark, sf):
    c = table(spark, sf, "customer")
    target = c.select("c_custkey", "c_acctbal", F.lit(0).cast("bigint").alias("version"))
    ch1 = c.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"),
                                                               F.lit(1).cast("bigint").alias("version"))
    ch2 = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        "c_custkey", (F.col("c_acctbal") + 2).alias("c_acctbal"), F.lit(2).cast("bigint").alias("version"))
    return IO.upsert_latest(target, ch1.unionByName(ch2), ["c_custkey"], ["version"]).select("c_custkey", "c_acctbal",
                                                                                              "version")


@query("append_prediction", f"""WITH {PRED_CTE}
SELECT p.event_id, md5('user-' || p.user_id) AS program_id, (p.pred_slot) AS pred_slot FROM pred p
WHERE 'user-' || p.user_id IN (SELECT DISTINCT 'user-' || user_id FROM events)""")
def q_append_prediction(spark, sf):
    progs, _ = _star(spark, sf)
    p = predictions(spark, sf).withColumn("program", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return _r(IO.append_prediction(p, progs, "program").select("event_id", "program_id", "pred_slot"))


def _cells(spark, sf):
    return A.bias_cells(predictions(spark, sf), ["event_type", "dow"], "actual", "pred_slot")


@query("corrections_json")
def q_corrections_json(spark, sf):
    return IO.corrections_to_json(_cells(spark, sf), ["event_type", "dow"], "correction")


@query("corrections_roundtrip", f"""WITH {PRED_CTE}
SELECT event_type, CAST(dow AS VARCHAR) AS dow, (greatest(least(avg(actual - pred_slot), 0.3), -0.3)) AS correction
FROM pred GROUP BY event_type, dow HAVING count(*) >= 30 AND abs(avg(actual - pred_slot)) >= 0.1""")
def q_corrections_roundtrip(spark, sf):
    js = IO.corrections_to_json(_cells(spark, sf), ["event_type", "dow"], "correction")
    return _r(IO.corrections_from_json(js, "json", ["event_type", "dow"]))


_ENUM_STATUS = ["F", "O"]
_ENUM_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("constraint_report", f"""SELECT 'orders.o_custkey not null' AS constraint, CAST(count_if(o_custkey IS NULL) AS BIGINT) AS n_violations FROM orders
UNION ALL SELECT 'orders(o_orderkey) unique', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders(o_custkey,o_orderdate) unique', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
UNION ALL SELECT 'orders.o_orderstatus in enum', CAST(count_if(o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ({', '.join(repr(x) for x in _ENUM_STATUS)})) AS BIGINT) FROM orders
UNION ALL SELECT 'orders.o_orderpriority in enum', CAST(count_if(o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ({', '.join(repr(x) for x in _ENUM_PRIO)})) AS BIGINT) FROM orders
UNION ALL SELECT 'orders.o_custkey -> parent', CAST(count(*) AS BIGINT) FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'orders check price over 1000 unless open', CAST(count_if(NOT (o_totalprice > 1000 OR o_orderstatus = 'O')) AS BIGINT) FROM orders""")
def q_constraint_report(spark, sf):
    o = table(spark, sf, "orders")
    return IO.constraint_report(o, "orders", not_null=["o_custkey"], unique=[["o_orderkey"], ["o_custkey", "o_orderdate"]],
                                enums={"o_orderstatus": _ENUM_STATUS, "o_orderpriority": _ENUM_PRIO},
                                fks=[("o_custkey", table(spark, sf, "customer"), "c_custkey")],
                                checks={"price over 1000 unless open": (F.col("o_totalprice") > 1000) | (F.col("o_orderstatus") == "O")})


# S11, S19 -------------------------------------------------------------------------
@query("load_once", "SELECT CAST(count(*) AS BIGINT) AS n_loaded, true AS second_refused FROM orders")
def q_load_once(spark, sf):
    """A load into an empty target passes, a second one is refused."""
    o = table(spark, sf, "orders")
    IO.assert_empty(o.limit(0))
    path = IO.write_artifact(o, IO.scratch_path(spark, "orders_target"), "parquet")
    target = spark.read.schema(o.schema).parquet(path)
    try:
        IO.assert_empty(target)
        refused = False
    except RuntimeError:
        refused = True
    return target.agg(F.count("*").alias("n_loaded")).withColumn("second_refused", F.lit(refused))


@query("model_run_log", """SELECT 'price' AS name, CAST(count(*) AS BIGINT) AS n_train, regr_slope(l_extendedprice, l_quantity) AS slope,
  regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem""")
def q_model_run_log(spark, sf):
    """A line fitted, saved with its metadata and read back, with the
    run log's row count beside its coefficients."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    fit = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                           LinearRegression(labelCol="y", solver="normal", regParam=0.0)]).fit(li)
    path = IO.scratch_path(spark, "price_model")
    IO.save_model(fit, {"name": "price", "features": ["x"]}, path)
    IO.append_run_log(spark, {"name": "price", "n_train": li.count()}, f"{path}/runs")
    line = PipelineModel.load(f"{path}/model").stages[-1]
    runs = spark.read.text(f"{path}/runs").select(F.from_json("value", "name string, n_train long").alias("r")).select("r.*")
    return runs.select("name", "n_train", F.lit(float(line.coefficients[0])).alias("slope"), F.lit(float(line.intercept)).alias("intercept"))


@query("append_unseen", f"""WITH dly AS (SELECT d, avg(value) AS v FROM {EV} GROUP BY d),
p AS (SELECT 'spike' AS category, 'spike-' || CAST(d AS VARCHAR) AS name, d AS start_date, d AS end_date FROM dly
      WHERE v > 1.05 * (SELECT avg(value) FROM events)),
t AS (SELECT category, name, start_date, end_date FROM {IV})
SELECT * FROM t UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.name = p.name AND t.start_date = p.start_date)""")
def q_append_unseen(spark, sf):
    from ratecast.plans.tables import intervals
    ev = events(spark, sf)
    mean = ev.agg(F.avg("value")).scalar()
    dly = ev.groupBy("d").agg(F.avg("value").alias("v")).where(F.col("v") > mean * 1.05)
    props = dly.select(F.lit("spike").alias("category"), F.concat(F.lit("spike-"), F.col("d").cast("string")).alias("name"),
                       F.col("d").alias("start_date"), F.col("d").alias("end_date"))
    target = intervals(spark).select("category", "name", "start_date", "end_date")
    return IO.append_unseen(target, props, ["name", "start_date"])


@query("load_summary", f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, min(d) AS first_date, max(d) AS last_date,
  (avg(value)) AS mean FROM {EV}""")
def q_load_summary(spark, sf):
    return _r(IO.load_summary(events(spark, sf), "d", "value"))


# S2 + F1-F9 + J4/J5: the ingest lifecycle end to end ---------------------------------
RAW_COLS = ["program", "weekday", "air_date", "start_time", "end_time", "duration", "rating", "share", "viewers_4plus", "reach_4plus",
            "view_duration", "comp_11", "comp_12", "comp_13", "comp_14"]
_NUMBERS = ("rating", "share", "viewers_4plus", "reach_4plus")
_RAW_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in _NUMBERS or c.startswith("comp")
                                          else T.StringType()) for c in RAW_COLS])


def _raw_from_events(spark, sf):
    """A raw broadcast log derived from every event (text times, hours 24/25)."""
    from ratecast.functions.scalars import weekday_name
    ev = _start_time(events(spark, sf))
    mins = F.floor("value").cast("int")
    return ev.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string"),
                 F.when(F.col("event_type") == "view", F.lit(" ש.ח")).otherwise(F.lit(""))).alias("program"),
        weekday_name("d").alias("weekday"), F.date_format("d", "yyyy-MM-dd").alias("air_date"), "start_time",
        F.format_string("%02d:%02d:30", (F.col("h") + 1).cast("int"), F.pmod(mins, F.lit(60))).alias("end_time"),
        F.format_string("%02d:%02d:00", (mins / 60).cast("int"), mins % 60).alias("duration"),
        (F.col("value") / 100).alias("rating"), (F.col("k") / 10).alias("share"),
        (F.col("value") * 10).alias("viewers_4plus"), (F.col("value") * 25).alias("reach_4plus"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.format_string("00:%02d:15", mins % 60)).alias("view_duration"),
        (F.col("k") / 100).alias("comp_11"), (F.col("value") / 200).alias("comp_12"),
        F.when(F.col("event_type") != "error", F.col("k") / 50).alias("comp_13"), F.lit(0.0).alias("comp_14"))


_RAW_SQL_SRC = f"""(SELECT 'user-' || user_id || CASE WHEN event_type = 'view' THEN ' ש.ח' ELSE '' END AS program,
  CAST(d AS VARCHAR) AS air_date, printf('%02d:%02d:%02d', h + CASE WHEN h < 2 THEN 24 ELSE 0 END, minute(ts),
  CAST(floor(second(ts)) AS INTEGER)) AS start_time, CAST(floor(value) AS INTEGER) AS mins, value / 100 AS rating,
  k / 10 AS share, value * 10 AS viewers_4plus, value * 25 AS reach_4plus, event_type = 'error' AS no_view, h,
  k / 100 AS comp_11, value / 200 AS comp_12, CASE WHEN event_type <> 'error' THEN k / 50 END AS comp_13,
  0.0 AS comp_14, d FROM {EV})"""
_PM4 = ("((coalesce(comp_11, 0) + coalesce(comp_12, 0) + coalesce(comp_13, 0) + coalesce(comp_14, 0)) / "
        "nullif(CAST(comp_11 IS NOT NULL AS INT) + CAST(comp_12 IS NOT NULL AS INT) + CAST(comp_13 IS NOT NULL AS INT) "
        "+ CAST(comp_14 IS NOT NULL AS INT), 0))")
_HF = "CAST(floor((CAST(split_part(start_time, ':', 1) AS DOUBLE) * 60 + CAST(split_part(start_time, ':', 2) AS DOUBLE) + CAST(split_part(start_time, ':', 3) AS DOUBLE) / 60) / 60) AS INTEGER)"


def _raw_ingest_sql():
    from ratecast.functions.scalars import STATUS_DEFAULT_HE, STATUS_RULES_HE
    from ratecast.functions.scalars import WEEKDAYS_HE
    from ratecast.plans.q_aggregates import _DP_SQL
    _WD = "CASE dayofweek(d) " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WEEKDAYS_HE)) + " END"
    status = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(program, '{n}')" for n in needles) + f" THEN '{lab}'"
                                for needles, lab in STATUS_RULES_HE) + f" ELSE '{STATUS_DEFAULT_HE}' END"
    sec = ("coalesce((SELECT string_agg(i.name, ' + ' ORDER BY i.ord) FROM " + IV + " i WHERE i.category IN "
           "('security', 'political') AND i.end_date IS NOT NULL AND r.d BETWEEN i.start_date AND i.end_date), '—')")
    return f"""SELECT program, CAST(air_date AS DATE) AS air_date, start_time,
  printf('%02d:%02d:30', CAST(h + 1 AS INTEGER), mins % 60) AS end_time, share, viewers_4plus, reach_4plus,
  CASE WHEN NOT no_view THEN mins % 60 + 0.25 END AS view_dur_min,
  CAST({_WD} AS VARCHAR) AS weekday, ((mins // 60) * 60 + mins % 60) AS duration_min, hf AS start_hour,
  {_DP_SQL.replace('h ', 'hf ').replace('h>', 'hf>')} AS daypart,
  coalesce(regexp_matches(program, 'ש\\.ח|לקט'), false) AS is_rerun,
  trim(regexp_replace(program, '\\s*ש\\.ח\\s*$', '')) AS program_source,
  ({_PM4}) AS competitors_avg, (rating - {_PM4}) AS advantage,
  (coalesce(comp_11, 0) + coalesce(comp_12, 0) + coalesce(comp_13, 0) + coalesce(comp_14, 0) + rating) AS hut_proxy,
  0.65 AS reception_pct, (rating / 0.65) AS rating_adj, {status} AS status, {sec} AS tag_security
FROM (SELECT *, {_HF} AS hf FROM {_RAW_SQL_SRC}) r"""


@query("raw_ingest", _raw_ingest_sql())
def q_raw_ingest(spark, sf):
    """Raw CSV (every event as a broadcast row, text times) -> required-column
    check over all 15 columns -> derived features (F1-F9) -> interval tags.
    The banner-line path of the reader is covered by the unit tests."""
    from ratecast.functions import scalars as S
    from ratecast.plans.tables import intervals
    path = IO.write_artifact(_raw_from_events(spark, sf), IO.scratch_path(spark, "raw_broadcasts"), "csv")
    df = IO.read_raw_csv(spark, path, _RAW_SCHEMA, RAW_COLS, "program")
    comps = ["comp_11", "comp_12", "comp_13", "comp_14"]
    hf = S.hour_of("start_time", "floor")
    rec = S.reception("air_date", "monthly_clamped")
    out = df.select(
        "program", F.to_date("air_date").alias("air_date"), "start_time",
        "end_time", "share", "viewers_4plus", "reach_4plus", S.hms_to_minutes("view_duration").alias("view_dur_min"), "weekday",
        S.hms_to_minutes("duration").alias("duration_min"), hf.alias("start_hour"), S.daypart(hf).alias("daypart"),
        S.is_rerun("program").alias("is_rerun"), S.source_name("program").alias("program_source"),
        S.peer_mean(comps).alias("competitors_avg"), S.advantage("rating", comps).alias("advantage"),
        S.hut("rating", comps).alias("hut_proxy"), rec.alias("reception_pct"),
        S.adjusted("rating", rec).alias("rating_adj"), S.status_of("program").alias("status"))
    out = I.interval_tag(out, intervals(spark), "air_date", out="tag_security", mode="concat", cats=SEC_CATS)
    return _r(out, "start_hour")
