"""Sorts, limits, top-k and sampling (survey K1-K6).

Global top-k uses ``orderBy().limit()``, which Spark plans as a
per-partition top-k followed by a merge of k rows per partition
(TakeOrderedAndProject): no full sort, no single hot task.  Per-group
top-k goes through the salted two-stage rank in ``windows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecast.operators.windows import top_n_per_group


def top_errors(df: DataFrame, actual: str, pred: str, n: int, mode: str = "abs", tiebreak: Sequence[str] = (),
               digits: int = 3) -> DataFrame:
    """K1: largest errors (error = actual - pred, T22).  ``abs``: by
    |error|; ``under``: most under-predicted (error > 0); ``over``: most
    over-predicted (error < 0)."""
    e = F.col(actual) - F.col(pred)
    x = df.withColumn("error", e).withColumn("abs_error", F.abs(e))
    if mode == "abs":
        o = [F.col("abs_error").desc()]
    elif mode == "under":
        x, o = x.where(F.col("error") > 0), [F.col("error").desc()]
    elif mode == "over":
        x, o = x.where(F.col("error") < 0), [F.col("error").asc()]
    else:
        raise ValueError(mode)
    x = x.orderBy(*o, *[F.col(t) for t in tiebreak]).limit(n)
    return (x.withColumn("error", F.round("error", digits)).withColumn("abs_error", F.round("abs_error", digits)))


def n_extreme(df: DataFrame, by, n: int, largest: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """K2: n rows with the largest / smallest value of ``by``."""
    c = F.col(by) if isinstance(by, str) else by
    return df.orderBy(c.desc() if largest else c.asc(), *[F.col(t) for t in tiebreak]).limit(n)


def order_by_list(df: DataFrame, c: str, values: Sequence, out: str = "order_key") -> DataFrame:
    """K3: a sort key following a fixed category list; unknown values last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    return df.withColumn(out, F.when(pos > 0, pos).otherwise(F.lit(len(values) + 1)).cast("bigint"))


def worst_per_model(long: DataFrame, actual: str, by: str, n: int, min_n: int = 0) -> DataFrame:
    """K4: per model, the ``n`` segments with the highest MAE among those
    with at least ``min_n`` rows."""
    seg = (long.groupBy("model", by).agg(F.count("*").alias("n"),
                                         F.avg(F.abs(F.col("pred") - F.col(actual))).alias("mae"))
           .where(F.col("n") >= min_n))
    return top_n_per_group(seg, ["model"], [F.col("mae").desc(), F.col(by)], n, out="rank")


# A seeded digest of the key's text, which any SQL engine can repeat.
def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_words(key: Column, seed: int) -> tuple[Column, Column]:
    """Two 32-bit words from a digest of the whole key, so keys that differ
    anywhere differ here (up to chance in 64 bits)."""
    d = _digest(key, seed)
    return tuple(F.conv(F.substring(d, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def mix_hash(key: Column, seed: int) -> Column:
    """A hash of a key with 60 bits."""
    return F.conv(F.substring(_digest(key, seed), 1, 15), 16, 10).cast("bigint")


def hash_words_sql(key: str, seed: int) -> tuple[str, str]:
    return tuple(f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), {at}, 8) AS BIGINT)" for at in (1, 9))


def mix_hash_sql(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """K5: reproducible sample of ``n`` rows: the rows with the smallest
    seeded hash of an integer key (independent of partitioning)."""
    return df.withColumn("_h", mix_hash(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


def best_model(df: DataFrame, actual: str, preds: Sequence[str], names: Sequence[str] | None = None,
               out: str = "best_model") -> DataFrame:
    """Per row the model with the smallest absolute error; ties go
    to the earlier model in the list."""
    names = list(names or preds)
    items = [F.struct(F.abs(F.col(p) - F.col(actual)).alias("e"), F.lit(i).alias("o"), F.lit(nm).alias("m"))
             for i, (p, nm) in enumerate(zip(preds, names))]
    return df.withColumn(out, F.array_min(F.array(*items))["m"])
