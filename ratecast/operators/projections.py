"""Projections, filters and cleaning (survey P1-P14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecast.operators.quantiles import quantiles


def project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep, rename and order columns (``old -> new``)."""
    return df.select(*[F.col(o).alias(n) for o, n in mapping.items()])


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P2."""
    return df.dropna(subset=list(cols))


def filter_contains_eq(df: DataFrame, text: str, needle: str, eq: dict | None = None) -> DataFrame:
    """Text contains ``needle`` AND every equality in ``eq``."""
    cond = F.col(text).contains(needle)
    for c, v in (eq or {}).items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def filter_in(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    """P4 (pushed to the scan as an In filter)."""
    return df.where(F.col(c).isin(list(values)))


def lookback(df: DataFrame, date: str, target, days: int = 90, min_rows: int = 200) -> DataFrame:
    """P5: history strictly before ``target``, restricted to the last
    ``days`` days unless that window holds fewer than ``min_rows`` rows,
    in which case all earlier history is kept.  One plan: the window size
    is a scalar subquery."""
    d = F.to_date(date)
    t = F.to_date(target) if isinstance(target, Column) else F.lit(target).cast("date")
    before = d < t
    recent = d >= F.date_sub(t, days)
    n_recent = df.where(before & recent).agg(F.count("*")).scalar()
    return df.where(before & (recent | (n_recent < min_rows)))


def search(df: DataFrame, text: str, q: str, eq: dict | None = None) -> DataFrame:
    """Case-insensitive substring search plus equality filters."""
    cond = F.lower(F.col(text)).contains(q.lower())
    for c, v in (eq or {}).items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def tenant_rows(df: DataFrame, org: str, user_orgs: DataFrame, user_id, user_col: str = "user_id",
                org_col: str = "organization_id") -> DataFrame:
    """Rows visible to one user = rows of the user's organisation(s);
    a semi join, so it stays a row filter."""
    mine = user_orgs.where(F.col(user_col) == F.lit(user_id)).select(F.col(org_col).alias(org))
    return df.join(mine, org, "left_semi")


def tenant_visibility(df: DataFrame, org: str, user_orgs: DataFrame, value: str, user_col: str = "user_id",
                      org_col: str = "organization_id") -> DataFrame:
    """P7 for every user at once: rows (and their total) each user may see.
    Rows are aggregated per organisation first, then joined to users, so
    no (user, row) pairs are ever formed."""
    per_org = df.groupBy(F.col(org).alias(org_col)).agg(F.count("*").alias("n_visible"), F.sum(value).alias("total"))
    return user_orgs.select(user_col, org_col).join(per_org, org_col, "left").select(
        user_col, F.coalesce(F.col("n_visible"), F.lit(0)).cast("bigint").alias("n_visible"), "total")


def tenant_insert_violations(df: DataFrame, org: str, user: str, user_orgs: DataFrame,
                             user_col: str = "user_id", org_col: str = "organization_id") -> DataFrame:
    """P7 insert rule as a report: rows whose org is not the inserting
    user's organisation."""
    ok = user_orgs.select(F.col(user_col).alias(user), F.col(org_col).alias(org))
    return df.join(ok, [user, org], "left_anti")


def fill_constant(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """P8."""
    return df.fillna(value, subset=list(cols))


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coerce to double (bad text -> null), then fill nulls with the
    exact column median."""
    out = df
    for c in cols:
        x = F.col(c).cast("string").try_cast("double") if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
        out = out.withColumn(c, x)
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(quantiles(out, c, [0.5])[0]).cast("double")))
    return out


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10."""
    for c in cols:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing column with its default."""
    for c, v in defaults.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    return df


def drop_leakage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns known after the fact, and fail if any remain."""
    out = df.drop(*cols)
    left = [c for c in cols if c in out.columns]
    if left:
        raise ValueError(f"leakage columns still present: {left}")
    return out


def with_error(df: DataFrame, pred: str, actual: str, out: str = "prediction_error") -> DataFrame:
    """Generated column error = pred - actual."""
    return df.withColumn(out, F.col(pred) - F.col(actual))


def backfill_actuals(preds: DataFrame, actuals: DataFrame, key: Sequence[str], actual: str = "actual") -> DataFrame:
    """Fill missing actuals from a later table (existing values kept)."""
    a = actuals.select(*key, F.col(actual).alias("_a"))
    return (preds.join(a, list(key), "left")
            .withColumn(actual, F.coalesce(F.col(actual), F.col("_a"))).drop("_a"))
