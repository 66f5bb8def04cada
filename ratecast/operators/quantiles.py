"""Exact quantiles without a value table in one task.

Spark's ``percentile`` and ``median`` merge a value-to-count map of each
group in one task.  Here values are reduced to (keys, value) counts, cut
into pieces along (keys, value), and the values at the wanted ranks are
read off two-level prefix counts, so neither a group nor a distinct value
range has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecast.operators.windows import PIECE_ROWS, counted_pieces, running_totals


def group_quantiles(df: DataFrame, keys: Sequence[str], value, qs: Sequence[float], out: str = "q",
                    rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """(keys, ``out``): linear-interpolated quantiles ``qs`` of the non-null
    values as an array of doubles; groups without a value are left out."""
    v = value if isinstance(value, Column) else F.col(value)
    per = (df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
           .groupBy(*keys, "_v").agg(F.count("*").alias("_n")))
    return quantiles_of_counts(per, keys, qs, out, rows_per_piece)


def quantiles_of_counts(per: DataFrame, keys: Sequence[str], qs: Sequence[float], out: str = "q", rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """The same from (keys, ``_v``, ``_n``): distinct values and their counts."""
    per, chunk = counted_pieces(per, [*keys, "_v"], rows_per_piece)
    cum = running_totals(per, keys, ["_v"], sums={"_b": F.col("_n")}, chunk=chunk, rows_per_piece=None)
    total = per.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    if keys:
        total = total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_t")
        cum = cum.join(total, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    else:
        cum = cum.withColumn("_t", total.scalar())
    aggs, found = [], []
    for i, q in enumerate(qs):
        rank = (F.col("_t") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("_b") <= at) & (at < F.col("_b") + F.col("_n"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
        aggs.append(F.max(rank - F.floor(rank)).alias(f"_f{i}"))
        found.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))
    return cum.groupBy(*keys).agg(*aggs).select(*keys, F.array(*found).alias(out))


def quantiles(df: DataFrame, value, qs: Sequence[float]) -> list[float | None]:
    """The quantiles ``qs`` of a whole column, as numbers; nulls without a value."""
    row = group_quantiles(df, [], value, qs).first()
    return list(row[0]) if row else [None] * len(qs)


def with_quantiles(groups: DataFrame, df: DataFrame, keys: Sequence[str], value, names: dict[str, float]) -> DataFrame:
    """Add quantiles of ``value`` over the rows ``df`` to a table with one
    row per ``keys`` (null keys match): column name -> quantile."""
    if not keys:
        return groups.withColumns({n: F.lit(v).cast("double") for n, v in zip(names, quantiles(df, value, list(names.values())))})
    q = group_quantiles(df, keys, value, list(names.values()), out="_q")
    q = q.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    j = groups.join(q, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], "left")
    return j.drop(*[f"_g_{k}" for k in keys])
