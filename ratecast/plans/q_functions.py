"""Scalar-function queries (F1-F25, S16) on columns Spark derives from
the driver tables (e.g. broadcast-style ``HH:MM:SS`` start times, with
hours 24/25 for the small hours, built from ``events.ts``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.functions import scalars as S
from ratecast.functions import text as X
from ratecast.plans.predictions import PRED_CTE, predictions, split_events
from ratecast.plans.q_aggregates import _DP_SQL, _r
from ratecast.plans.registry import query
from ratecast.plans.tables import EVENTS_SQL, events, table

EV = EVENTS_SQL
TODAY = "2026-06-01"


def _start_time(ev):
    """Broadcast-day clock: hours 0 and 1 are written as 24 and 25."""
    hh = F.col("h") + F.when(F.col("h") < 2, 24).otherwise(0)
    return ev.withColumn("start_time", F.format_string("%02d:%02d:%02d", hh, F.minute("ts"), F.second("ts")))


_ST = ("printf('%02d:%02d:%02d', h + CASE WHEN h < 2 THEN 24 ELSE 0 END, minute(ts), "
       "CAST(floor(second(ts)) AS INTEGER)) AS start_time")
_STV = f"(SELECT *, {_ST} FROM {EV})"
_MIN_SQL = ("CAST(split_part(start_time, ':', 1) AS DOUBLE) * 60 + CAST(split_part(start_time, ':', 2) AS DOUBLE) "
            "+ CAST(split_part(start_time, ':', 3) AS DOUBLE) / 60")


@query("hms_minutes", f"SELECT event_id, start_time, ({_MIN_SQL}) AS minutes FROM {_STV}")
def q_hms_minutes(spark, sf):
    e = _start_time(events(spark, sf))
    return _r(e.select("event_id", "start_time", S.hms_to_minutes("start_time").alias("minutes")))


@query("time_of_day", f"""SELECT event_id, printf('%02d:%02d:%02d', CAST(split_part(start_time, ':', 1) AS INTEGER) % 24,
  CAST(split_part(start_time, ':', 2) AS INTEGER), CAST(split_part(start_time, ':', 3) AS INTEGER)) AS tod FROM {_STV}""")
def q_time_of_day(spark, sf):
    e = _start_time(events(spark, sf))
    return e.select("event_id", S.time_of_day("start_time").alias("tod"))


@query("hour_variants", f"""SELECT event_id, CAST(floor(({_MIN_SQL}) / 60) AS INTEGER) AS hour_floor,
  CASE WHEN CAST(split_part(start_time, ':', 1) AS INTEGER) < 24 THEN CAST(split_part(start_time, ':', 1) AS INTEGER) ELSE 20 END
    AS hour_strict,
  CAST(floor(({_MIN_SQL}) / 60) AS INTEGER) % 24 AS hour_mod24,
  {_DP_SQL.replace('h ', 'hf ').replace('h>', 'hf>')} AS daypart FROM (SELECT *, CAST(floor(({_MIN_SQL}) / 60) AS INTEGER) AS hf
  FROM {_STV})""")
def q_hour_variants(spark, sf):
    e = _start_time(events(spark, sf))
    hf = S.hour_of("start_time", "floor")
    return e.select("event_id", hf.alias("hour_floor"), S.hour_of("start_time", "strict").alias("hour_strict"),
                    S.hour_of("start_time", "mod24").alias("hour_mod24"), S.daypart(hf).alias("daypart"))


# Status rules re-aimed at part names (same ordered precedence).
PART_RULES = [(["red", "hot"], "special"), (["small"], "compilation"), (["gear"], "holiday"), (["bolt"], "rerun")]


@query("status_rules", """SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'hot') THEN 'special'
  WHEN contains(p_name, 'small') THEN 'compilation' WHEN contains(p_name, 'gear') THEN 'holiday'
  WHEN contains(p_name, 'bolt') THEN 'rerun' ELSE 'live' END AS status FROM part""")
def q_status_rules(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.status_of("p_name", PART_RULES, "live").alias("status"))


@query("rerun_source", r"""SELECT p_partkey, coalesce(regexp_matches(p_name, 'widget|gizmo'), false) AS is_rerun,
  trim(regexp_replace(p_name, '\s*widget\s*$', '')) AS source_name FROM part""")
def q_rerun_source(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.is_rerun("p_name", "widget|gizmo").alias("is_rerun"),
                    S.source_name("p_name", r"\s*widget\s*$").alias("source_name"))


_RD = "CAST(o_orderdate + INTERVAL 360 MONTH AS DATE)"


@query("reception", f"""SELECT o_orderkey,
  (CASE WHEN datediff('month', DATE '2025-05-01', date_trunc('month', {_RD})) <= 0 THEN 0.65
    ELSE least(0.65 + 0.25 * datediff('month', DATE '2025-05-01', date_trunc('month', {_RD})) / 11, 0.90) END) AS rec_clamped,
  (CASE WHEN datediff('month', DATE '2025-05-01', date_trunc('month', {_RD})) <= 0 THEN 0.65
    ELSE least(0.65 + 0.25 * datediff('month', DATE '2025-05-01', date_trunc('month', {_RD})) / 11, 0.95) END) AS rec_extrapolated,
  (CASE WHEN {_RD} <= DATE '2025-05-01' THEN 0.65
    ELSE round(least(0.65 + 0.25 * datediff('day', DATE '2025-05-01', {_RD}) / 364, 0.95), 3) END) AS rec_daily,
  (o_totalprice / CASE WHEN datediff('month', DATE '2025-05-01', date_trunc('month', {_RD})) <= 0 THEN 0.65
    ELSE least(0.65 + 0.25 * datediff('month', DATE '2025-05-01', date_trunc('month', {_RD})) / 11, 0.90) END) AS adjusted
FROM orders""")
def q_reception(spark, sf):
    o = table(spark, sf, "orders").withColumn("rd", F.add_months(F.to_date("o_orderdate"), 360))
    rc = S.reception("rd", "monthly_clamped")
    return _r(o.select("o_orderkey", rc.alias("rec_clamped"), S.reception("rd", "monthly_extrapolated").alias("rec_extrapolated"),
                       S.reception("rd", "daily").alias("rec_daily"), S.adjusted("o_totalprice", rc).alias("adjusted")))


@query("calendar_fields", "SELECT event_id, list_extract([" + ", ".join(f"'{w}'" for w in S.WEEKDAYS_HE)
       + f"], dayofweek(d) + 1) AS weekday, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, "
       f"CAST(weekofyear(d) AS INTEGER) AS iso_week FROM {EV}")
def q_calendar_fields(spark, sf):
    e = events(spark, sf)
    parts = S.calendar_parts("d")
    return e.select("event_id", S.weekday_name("d").alias("weekday"), *[v.alias(k) for k, v in parts.items()])


_PEERS = ["l_quantity", "l_discount", "l_tax"]
_PM = "((coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0)) / nullif(CAST(l_quantity IS NOT NULL AS INT) + CAST(l_discount IS NOT NULL AS INT) + CAST(l_tax IS NOT NULL AS INT), 0))"


@query("peer_stats", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({_PM}) AS peer_mean,
  (l_extendedprice / 1000 - {_PM}) AS advantage,
  (coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0) + l_extendedprice / 1000) AS hut FROM lineitem""")
def q_peer_stats(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("r", F.col("l_extendedprice") / 1000)
    return _r(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.peer_mean(_PEERS).alias("peer_mean"),
                        S.advantage("r", _PEERS).alias("advantage"), S.hut("r", _PEERS).alias("hut")))


@query("slot_key", f"SELECT event_id, concat_ws('_', coalesce(event_type, 'nan'), CAST(dow AS VARCHAR), CAST(h AS VARCHAR)) AS slot FROM {EV}")
def q_slot_key(spark, sf):
    return events(spark, sf).select("event_id", S.slot_key("event_type", "dow", "h").alias("slot"))


@query("duration_wrap", f"""WITH x AS (SELECT event_id, start_time, CASE WHEN event_type = 'error' THEN NULL ELSE
  strftime(ts + to_minutes(CAST(floor(value) AS BIGINT)), '%H:%M') END AS end_time FROM {_STV}),
y AS (SELECT *, CAST(regexp_extract(end_time, '^(\\d{{1,2}}):(\\d{{2}})', 1) AS INTEGER) * 60
  + CAST(regexp_extract(end_time, '^(\\d{{1,2}}):(\\d{{2}})', 2) AS INTEGER)
  - (CAST(regexp_extract(start_time, '^(\\d{{1,2}}):(\\d{{2}})', 1) AS INTEGER) * 60
  + CAST(regexp_extract(start_time, '^(\\d{{1,2}}):(\\d{{2}})', 2) AS INTEGER)) AS dd FROM x)
SELECT event_id, CAST(CASE WHEN end_time IS NULL THEN 130 WHEN dd < 0 THEN dd + 1440 ELSE dd END AS INTEGER) AS duration FROM y""")
def q_duration_wrap(spark, sf):
    e = _start_time(events(spark, sf))
    end = F.when(F.col("event_type") != "error", F.date_format(
        F.expr("timestampadd(MINUTE, CAST(floor(value) AS BIGINT), ts)"), "HH:mm"))
    e = e.withColumn("end_time", end)
    return e.select("event_id", S.duration_wrap("start_time", "end_time").cast("int").alias("duration"))


@query("viewers", f"""SELECT event_id, CAST(round_even(value / 100 * 25000, 0) AS BIGINT) AS households,
  CAST(round_even(CAST(round_even(value / 100 * 25000, 0) AS BIGINT) * CAST(2.3 AS DOUBLE), 0) AS BIGINT) AS viewers FROM {EV}""")
def q_viewers(spark, sf):
    e = events(spark, sf).withColumn("rating", F.col("value") / 100)
    return e.select("event_id", S.households("rating").alias("households"), S.viewers("rating").alias("viewers"))


@query("forecast_adjust", f"""WITH {PRED_CTE},
n AS (SELECT user_id, count(*) AS n FROM tr GROUP BY user_id),
x AS (SELECT p.*, datediff('day', (SELECT max(d) FROM tr), p.d) AS days_ahead, coalesce(n.n, 0) AS n_hist
      FROM pred p LEFT JOIN n USING (user_id)),
y AS (SELECT *, greatest(CASE WHEN days_ahead > 0 THEN pred_slot * pow(1 + 0.01, least(days_ahead / 30.0, 6.0))
      ELSE pred_slot END, 0.0) AS adj FROM x)
SELECT event_id, (adj) AS pred_adjusted, (greatest(adj - 12.8, 0.0)) AS low, (adj + 12.8) AS high,
  CASE WHEN n_hist >= 20 THEN 'high' WHEN n_hist >= 5 THEN 'medium' ELSE 'cold_start' END AS reliability FROM y""")
def q_forecast_adjust(spark, sf):
    ev = split_events(spark, sf)
    tr = ev.where(F.col("split") == "train")
    last = tr.agg(F.max("d")).scalar()
    n = tr.groupBy("user_id").agg(F.count("*").alias("n_hist"))
    p = (predictions(spark, sf).join(n, "user_id", "left").withColumn("n_hist", F.coalesce("n_hist", F.lit(0)))
         .withColumn("days_ahead", F.datediff("d", last)))
    adj = S.trend_scale("pred_slot", F.lit(0.01), "days_ahead")
    p = p.withColumn("adj", adj)
    return _r(p.select("event_id", F.col("adj").alias("pred_adjusted"), S.interval_low("adj", F.lit(12.8)).alias("low"),
                       S.interval_high("adj", F.lit(12.8)).alias("high"), S.reliability("n_hist").alias("reliability")))


@query("next_weekday", f"""SELECT event_id, CAST(d + CAST(CASE WHEN (5 - dayofweek(d) + 7) % 7 = 0 THEN 7
  ELSE (5 - dayofweek(d) + 7) % 7 END AS INTEGER) AS DATE) AS next_friday FROM {EV}""")
def q_next_weekday(spark, sf):
    return events(spark, sf).select("event_id", S.next_weekday("d", 5).alias("next_friday"))


def _text_date_sql(col, today=TODAY):
    t = f"DATE '{today}'"
    nxt = " OR ".join(f"contains({col}, '{w}')" for w in X.WORDS_NEXT)
    dows = ["SU", "MO", "TU", "WE", "TH", "FR", "SA"]
    parts = [f"WHEN contains({col}, '{X.WORD_TOMORROW}') THEN {t} + 1", f"WHEN contains({col}, '{X.WORD_TODAY}') THEN {t}",
             f"WHEN contains({col}, '{X.WORD_WEEK}') THEN {t} + 7", f"WHEN contains({col}, '{X.WORD_MONTH}') THEN {t} + 30"]
    for i, name in enumerate(S.WEEKDAYS_HE):
        parts.append(f"WHEN contains({col}, '{name}') AND ({nxt} OR contains({col}, 'ב{name}')) THEN "
                     f"{t} + CAST(CASE WHEN ({i} - dayofweek({t}) + 7) % 7 = 0 THEN 7 ELSE ({i} - dayofweek({t}) + 7) % 7 END AS INTEGER)")
    rx = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
    y = f"CAST(regexp_extract({col}, '{rx}', 3) AS INTEGER)"
    expl = (f"CASE WHEN regexp_matches({col}, '{rx}') THEN try(make_date(CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END, "
            f"CAST(regexp_extract({col}, '{rx}', 2) AS INTEGER), CAST(regexp_extract({col}, '{rx}', 1) AS INTEGER))) END")
    return "CASE " + " ".join(parts) + f" ELSE {expl} END"


# endings that texts get in turn, so that every kind of date word occurs in them
_DATE_ENDINGS = ["", " מחר", " היום", " עוד שבוע", " בחודש", " ביום שישי", " ראשון הבא", " 12/09/25", " 31/02/2026", " שבת"]
_INTENT_ENDINGS = ["", " מה הצפי לקבינט מחר", " קבינט", " מבצע", " שישי הבא אירוע", " היום"]


def _ending(number, endings):
    return F.element_at(F.array(*map(F.lit, endings)), (F.pmod(number, F.lit(len(endings))) + 1).cast("int"))


def _ending_sql(number, endings):
    return f"CASE CAST(({number}) % {len(endings)} AS INTEGER) " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(endings)) + " END"


@query("text_date", f"""SELECT doc_id, CAST({_text_date_sql('t')} AS DATE) AS asked_date
FROM (SELECT doc_id, trim(coalesce(text, '') || {_ending_sql('doc_id', _DATE_ENDINGS)}) AS t FROM documents)""")
def q_text_date(spark, sf):
    d = table(spark, sf, "documents")
    text = F.concat(F.coalesce("text", F.lit("")), _ending(F.col("doc_id"), _DATE_ENDINGS))
    return d.select("doc_id", X.text_date(text, TODAY).alias("asked_date"))


def _any_sql(col, words):
    return "(" + " OR ".join(f"contains(coalesce({col}, ''), '{w}')" for w in words) + ")"


@query("text_intent", f"""SELECT conv_id, turn, CASE WHEN {_any_sql('text', X.PROGRAM_WORDS)} THEN 'קבינט שישי' END AS program,
  CASE WHEN {_any_sql('text', X.SCENARIO_WORDS)} THEN 'special_event' ELSE 'routine' END AS scenario,
  CASE WHEN {_any_sql('text', X.PROGRAM_WORDS)} AND {_any_sql('text', [X.WORD_TOMORROW, X.WORD_TODAY, X.WORD_WEEK, *S.WEEKDAYS_HE])} THEN 'high'
       WHEN {_any_sql('text', X.PROGRAM_WORDS)} THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT conv_id, turn, coalesce(text, '') || {_ending_sql('conv_id + turn', _INTENT_ENDINGS)} AS text FROM conversations)""")
def q_text_intent(spark, sf):
    c = table(spark, sf, "conversations")
    c = c.withColumn("text", F.concat(F.coalesce("text", F.lit("")), _ending(F.col("conv_id") + F.col("turn"), _INTENT_ENDINGS)))
    prog = X.text_program("text")
    return c.select("conv_id", "turn", prog.alias("program"), X.text_scenario("text").alias("scenario"),
                    X.confidence("text", prog).alias("confidence"))


@query("json_field", r"""SELECT event_id, json_extract_string(props, '$.k') AS k_plain,
  CASE WHEN json_valid(regexp_extract('note: ' || props || ' (end)', '\{.*\}', 0))
       THEN json_extract_string(regexp_extract('note: ' || props || ' (end)', '\{.*\}', 0), '$.k') END AS k_prose
FROM events""")
def q_json_field(spark, sf):
    e = table(spark, sf, "events")
    prose = F.concat(F.lit("note: "), F.col("props"), F.lit(" (end)"))
    return e.select("event_id", X.json_field("props", "$.k").alias("k_plain"), X.json_field(prose, "$.k").alias("k_prose"))


@query("pub_date", f"""SELECT event_id, coalesce(CAST(try_strptime(txt, '%a, %d %b %Y %H:%M:%S') AS DATE), DATE '{TODAY}') AS pub_date
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%a, %d %b %Y %H:%M:%S') END AS txt FROM events)""")
def q_pub_date(spark, sf):
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"))
    return e.select("event_id", X.pub_date(txt, TODAY).alias("pub_date"))


@query("fmt", f"""SELECT o_orderkey, coalesce(format('{{:,.2f}}', v), '{S.NO_TAG}') AS amount_txt,
  coalesce(format('{{:,.1f}}%', v / 3000 * 100), '{S.NO_TAG}') AS share_txt
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS v FROM orders)""")
def q_fmt(spark, sf):
    o = table(spark, sf, "orders")
    v = F.when(o.o_orderkey % 9 != 0, o.o_totalprice)
    return o.select("o_orderkey", S.fmt_num(v, 2).alias("amount_txt"), S.fmt_pct(v / 3000, 1).alias("share_txt"))


@query("math_fns", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (greatest(least(l_discount, 0.08), 0.02)) AS clipped,
  (ln(l_extendedprice)) AS log_price, (abs(l_tax - l_discount)) AS abs_gap, (sqrt(l_quantity)) AS sqrt_qty
FROM lineitem""")
def q_math_fns(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        F.greatest(F.least("l_discount", F.lit(0.08)), F.lit(0.02)).alias("clipped"),
                        F.ln("l_extendedprice").alias("log_price"), F.abs(F.col("l_tax") - F.col("l_discount")).alias("abs_gap"),
                        F.sqrt("l_quantity").alias("sqrt_qty")))


@query("fourier", "SELECT ds, " + ", ".join(
    f"(sin(2 * pi() * {k} / 7 * t)) AS f_sin{k}, (cos(2 * pi() * {k} / 7 * t)) AS f_cos{k}" for k in (1, 2, 3))
    + f" FROM (SELECT DISTINCT d AS ds, datediff('day', DATE '2024-01-01', d) AS t FROM {EV})")
def q_fourier(spark, sf):
    days = events(spark, sf).select(F.col("d").alias("ds")).distinct().withColumn("t", F.datediff("ds", F.lit("2024-01-01")))
    fs = S.fourier("t", 7.0, 3)
    return _r(days.select("ds", *[v.alias(k) for k, v in fs.items()]))


@query("coalesce_text", """SELECT event_id, coalesce(nullif(json_extract_string(props, '$.name'), ''), nullif(event_type, ''),
  'unknown') AS label FROM events""")
def q_coalesce_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.coalesce_text(F.get_json_object("props", "$.name"), "event_type", F.lit("unknown")).alias("label"))


_LEVELS = ["click", "view", "purchase"]


@query("one_hot", f"SELECT event_id, " + ", ".join(
    f"CAST(coalesce(event_type = '{lv}', false) AS INTEGER) AS event_type_{lv}" for lv in _LEVELS) + " FROM events")
def q_one_hot(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", *[v.alias(k) for k, v in S.one_hot("event_type", _LEVELS).items()])


@query("link_items", r"""SELECT page_id, CAST(pos AS INTEGER) AS pos, href, txt FROM (
  SELECT page_id, unnest(generate_series(0, len(hs) - 1)) AS pos, hs, ts FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs,
           regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ts FROM pages) WHERE len(hs) > 0),
  LATERAL (SELECT hs[pos + 1] AS href, ts[pos + 1] AS txt)""")
def q_link_items(spark, sf):
    p = table(spark, sf, "pages")
    href, txt = X.link_items("html")
    z = p.select("page_id", F.posexplode(F.arrays_zip(href.alias("href"), txt.alias("txt"))).alias("pos", "it"))
    return z.select("page_id", F.col("pos").cast("int"), F.col("it.href").alias("href"), F.col("it.txt").alias("txt"))


# One feed per page: its links are the items.  Every seventh item has no title or a blank one, every
# fifth no date or an unreadable one, and every eleventh page breaks off inside an item.
_FEED_TODAY = "2026-03-01"


@query("feed_items", r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ts FROM pages WHERE page_id % 11 <> 0),
i AS (SELECT page_id, unnest(generate_series(1, len(ts))) AS i, ts FROM p),
t AS (SELECT page_id, i, trim(replace(replace(replace(ts[i], '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) AS title FROM i WHERE (page_id + i) % 7 <> 0)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS pos, title,
  CASE WHEN (page_id + i) % 5 = 0 THEN DATE '"""  + _FEED_TODAY + r"""' ELSE DATE '2024-01-01' + CAST((page_id * 31 + i) % 700 AS INTEGER) END AS pub_date
FROM t WHERE title <> ''""")
def q_feed_items(spark, sf):
    """XML feeds built from every page, then read back item by item."""
    p = table(spark, sf, "pages")
    _, texts = X.link_items("html")
    k = F.col("page_id")

    def item(text, at):
        n = k + at + 1
        title = F.when(F.pmod(n, F.lit(14)) == 0, F.lit("")).when(F.pmod(n, F.lit(7)) == 0, F.lit("<title>  </title>")).otherwise(
            F.concat(F.lit("<title> "), text, F.lit("</title>")))
        day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(k * 31 + at + 1, F.lit(700)).cast("int"))
        date = F.when(F.pmod(n, F.lit(10)) == 0, F.lit("")).when(F.pmod(n, F.lit(5)) == 0, F.lit("<pubDate>soon</pubDate>")).otherwise(
            F.concat(F.lit("<pubDate>"), F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 23:30:00 +0200</pubDate>")))
        return F.concat(F.lit("<item>"), title, date, F.lit("</item>"))

    items = F.array_join(F.transform(texts, item), "")
    end = F.when(F.pmod(k, F.lit(11)) == 0, F.lit("<item><title>broken")).otherwise(F.lit("</channel></rss>"))
    feeds = p.select("page_id", F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>'), items, end).alias("xml"))
    z = feeds.select("page_id", F.posexplode(X.feed_items("xml", _FEED_TODAY)).alias("pos", "it"))
    return z.select("page_id", (F.col("pos") + 1).alias("pos"), "it.title", "it.pub_date")


@query("constant_baselines", f"""WITH {PRED_CTE}
SELECT 'global' AS model, (avg(abs(pred_global - actual))) AS mae FROM pred
UNION ALL SELECT 'zero', (avg(abs(0 - actual))) FROM pred
UNION ALL SELECT 'oracle', (avg(abs((SELECT avg(actual) FROM pred) - actual))) FROM pred""")
def q_constant_baselines(spark, sf):
    from ratecast.operators.models import constant_baselines
    return _r(constant_baselines(predictions(spark, sf), "actual", "pred_global"))
