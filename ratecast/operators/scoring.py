"""Batch scoring of forecast requests and questions (survey M30, M31).

The model only supplies a raw prediction per request; every other answer
field is an expression or an aggregate of the history joined by equality,
so one plan answers any number of requests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecast.functions import scalars as S
from ratecast.functions import text as X
from ratecast.operators import intervals as I
from ratecast.operators import pointintime as PT
from ratecast.operators import windows as W

ROUTINE, SPECIAL = "routine", "special_event"


def effective_scenario(requests: DataFrame, iv: DataFrame, date: str, scenario: str, cats: Sequence[str]) -> DataFrame:
    """Adds ``tag_security`` (active events of ``cats``), ``is_security`` and
    ``scenario_effective``.  An event counts only where the request asks for
    one and one is active on its date; else the request is routine."""
    r = I.tag_with_days(requests, I.day_table(iv, [{"out": "_tag", "kind": "concat", "cats": list(cats)}]), date)
    on = (F.col(scenario) == SPECIAL) & F.col("_tag").isNotNull()
    on = F.coalesce(on, F.lit(False))
    return (r.withColumn("is_security", on).withColumn("tag_security", F.when(on, F.col("_tag")).otherwise(I.NO_TAG))
            .withColumn("scenario_effective", F.when(on, SPECIAL).otherwise(ROUTINE)).drop("_tag"))


def answer_fields(scored: DataFrame, history: DataFrame, *, entity: str, date: str, value: str, target: str,
                  fine: Sequence[str], coarse: Sequence[str], raw: str = "raw_pred", lookback: int = 6,
                  min_rows: int = 5, min_fine: int = 5, min_coarse: int = 10) -> DataFrame:
    """Requests with a raw prediction -> all answer fields: trend-scaled and
    floored prediction, 80% range, its raw form under the panel's reception,
    households, viewers, history count, reliability and cold-start flag.
    An entity with fewer than ``min_rows`` rows, or none, takes the trend of
    the whole history.  ``fine`` and ``coarse`` name the cells of the spread."""
    per = W.trend(history, entity, date, value, lookback, min_rows).select(F.col(entity).alias("_e"), "trend")
    whole = W.trend(history.withColumn("_all", F.lit(1)), "_all", date, value, lookback, 0).select("trend").scalar()
    n = history.groupBy(F.col(entity).alias("_k")).agg(F.count("*").alias("n_hist"))
    s = scored.join(per, F.col(entity) == F.col("_e"), "left").join(n, F.col(entity) == F.col("_k"), "left").drop("_e", "_k")
    s = (s.withColumn("trend", F.coalesce("trend", whole)).withColumn("n_hist", F.coalesce("n_hist", F.lit(0)).cast("bigint"))
         .withColumn("days_ahead", F.datediff(target, history.agg(F.max(F.to_date(date))).scalar()).cast("bigint")))
    s = s.withColumn("predicted", S.trend_scale(raw, F.col("trend"), F.col("days_ahead")))
    s = PT.uncertainty(s, history, (fine, fine), (coarse, coarse), value, min_fine=min_fine, min_coarse=min_coarse)
    s = s.withColumn("reception_used", S.reception(target, "daily"))
    s = s.withColumn("predicted_raw", F.col("predicted") * F.col("reception_used"))
    return (s.withColumn("low", S.interval_low("predicted", F.col("half_width"))).withColumn("high", S.interval_high("predicted", F.col("half_width")))
            .withColumn("households", S.households("predicted_raw")).withColumn("viewers", S.viewers("predicted_raw"))
            .withColumn("reliability", S.reliability("n_hist")).withColumn("cold_start", F.col("reliability") == "cold_start"))


ANSWER = ["predicted", "low", "high", "predicted_raw", "reception_used", "households", "viewers", "n_used", "unc_source",
          "n_hist", "reliability", "cold_start", "days_ahead"]


def parse_questions(df: DataFrame, text: str, today: str | Column, default_days: int = 7) -> DataFrame:
    """Adds ``program``, ``target`` (``default_days`` ahead where the text
    names no date), ``scenario`` and ``confidence`` (low without a program)."""
    t = F.to_date(today) if isinstance(today, Column) else F.lit(today).cast("date")
    prog = X.text_program(text)
    return (df.withColumn("program", prog).withColumn("target", F.coalesce(X.text_date(text, today), F.date_add(t, default_days)))
            .withColumn("scenario", X.text_scenario(text)).withColumn("confidence", X.confidence(text, prog)))
