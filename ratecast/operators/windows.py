"""Order-dependent operators (survey W1-W16, K7, T1-T5, T28-T30).

Every operator takes a *total* order (list of columns ending in a unique
tiebreaker).  Scale notes:

* A key with at most ``KEY_ROWS`` rows is one window partition: one shuffle
  by the key and no join back.  Keys with more (a bounded count of rows per
  key finds them) are cut along (key, order) into pieces of about that many
  rows by a range partition (``ordered_pieces``), so neither one key nor
  one day or value of a key meets in one task.  Running totals then take
  the sums of a key's earlier pieces (one row per key and piece) and a
  window per (key, piece); bounded frames run over blocks of row positions,
  each with copies of the rows just before it.
* "Global" orders (row index over the whole table) and value ranks are cut
  into pieces sized from the row count, so no window ever runs without a
  partition key over the raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecast.functions.scalars import div0
from ratecast.session import written

PIECE_ROWS = 4_000_000  # rows aimed at per piece of a global order
KEY_ROWS = 4_000_000    # rows of one key that may meet in one task, and per piece of a larger key
HOT_KEYS = 10_000       # larger keys that are passed as literals; more stay a table


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


# ---------------------------------------------------------------------------
# keys too large for one task
# ---------------------------------------------------------------------------
def _same(a: DataFrame, b: DataFrame, names: Sequence[str], prefix: str) -> Column:
    """Equality of ``names`` with the prefixed columns of ``b``; null keys are keys like any other."""
    cond = F.lit(True)
    for c in names:
        cond = cond & a[c].eqNullSafe(b[f"{prefix}{c}"])
    return cond


def split_heavy(df: DataFrame, keys: Sequence[str], rows_per_piece: int = KEY_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most ``rows_per_piece`` rows, rows of larger
    keys or None when there are none).  Rows per key are counted map-side;
    at most ``HOT_KEYS`` + 1 large keys reach the driver."""
    per = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_piece)
           .select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    hot = per.limit(HOT_KEYS + 1).collect()
    if not hot:
        return df, None
    if not keys:
        return df.limit(0), df
    if len(hot) <= HOT_KEYS:
        per = F.broadcast(df.sparkSession.createDataFrame(hot, per.schema))
    cond = _same(df, per, keys, "_h_")
    return df.join(per, cond, "left_anti"), df.join(per, cond, "left_semi")


def key_pieces(heavy: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_piece: int = KEY_ROWS) -> DataFrame:
    """Pieces of about ``rows_per_piece`` rows along (keys, order)."""
    return ordered_pieces(heavy, [*keys, *order], rows_per_piece)


# ---------------------------------------------------------------------------
# running totals (the shared building block)
# ---------------------------------------------------------------------------
def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   sums: dict[str, Column] | None = None, count_out: str | None = None,
                   chunk: Column | None = None, inclusive: bool = False,
                   rows_per_piece: int | None = KEY_ROWS) -> DataFrame:
    """Add prefix sums (``sums``: out name -> value expr) and a prefix row
    count (``count_out``) per ``keys`` in ``order``; exclusive of the
    current row unless ``inclusive``.

    Keys with more than ``rows_per_piece`` rows are cut into pieces; None
    says that the caller knows there are none.  A caller that has cut the
    rows itself names the cut by ``chunk`` (non-decreasing along ``order``
    within a key).
    """
    keys, sums = list(keys), dict(sums or {})
    if chunk is not None:
        return _chunked_totals(df.withColumn("_chunk", chunk), keys, order, sums, count_out, inclusive).drop("_chunk")
    light, heavy = (df, None) if rows_per_piece is None else split_heavy(df, keys, rows_per_piece)
    w = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = light.select("*", *[F.coalesce(F.sum(e).over(w), F.lit(0.0)).alias(n) for n, e in sums.items()],
                       *([F.count(F.lit(1)).over(w).alias(count_out)] if count_out else []))
    if heavy is None:
        return out
    cut = key_pieces(heavy, keys, order, rows_per_piece).withColumnRenamed("_piece", "_chunk")
    return out.unionByName(_chunked_totals(cut, keys, ["_pos"], sums, count_out, inclusive).drop("_chunk", "_pos"))


def _chunked_totals(base: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                    count_out: str | None, inclusive: bool) -> DataFrame:
    """Running totals in two levels over rows with a column ``_chunk``."""
    # (1) partial totals per (key, chunk): map-side combined, one row per chunk
    aggs = [F.coalesce(F.sum(e), F.lit(0.0)).alias(f"_cs_{n}") for n, e in sums.items()]
    per_chunk = base.groupBy(*keys, "_chunk").agg(*aggs, F.count(F.lit(1)).alias("_cn"))
    # (2) prefix over chunks (bounded by #chunks per key)
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    at = [*keys, "_chunk"]
    offs = per_chunk.select(*[F.col(k).alias(f"_j_{k}") for k in at],
                            *[F.coalesce(F.sum(f"_cs_{n}").over(wc), F.lit(0.0)).alias(f"_off_{n}") for n in sums],
                            F.coalesce(F.sum("_cn").over(wc), F.lit(0)).alias("_off_n"))
    # (3) within-chunk running totals
    wi = Window.partitionBy(*at).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    inner = base.select("*", *[F.coalesce(F.sum(e).over(wi), F.lit(0.0)).alias(f"_in_{n}") for n, e in sums.items()],
                        F.count(F.lit(1)).over(wi).alias("_in_n"))
    j = inner.join(offs, _same(inner, offs, at, "_j_"), "left")
    return j.select(*base.columns, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums],
                    *([(F.col("_in_n") + F.col("_off_n")).alias(count_out)] if count_out else []))


def ordered_pieces(df: DataFrame, order: Sequence[str], rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """Cut the table along ``order`` into pieces of about ``rows_per_piece``
    rows: adds ``_piece`` (rising along the order) and ``_pos`` (0-based
    place in the piece).

    Rows are range-partitioned by all of ``order``, so one day, hour or key
    that holds most rows is spread as well; only rows equal in all of
    ``order`` stay together.  The cut points come from a sample, so the
    pieces are written: every later step sees the same cut.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-df.count() // rows_per_piece))
    mid = F.monotonically_increasing_id()
    out = df.repartitionByRange(n, *_cols(order)).sortWithinPartitions(*_cols(order)).withColumn("_mid", mid)
    # the id holds the partition above bit 33 and the row's place below it
    out = out.withColumn("_piece", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
    return written(out.drop("_mid"), "pieces")


def counted_pieces(per: DataFrame, order: Sequence[str], rows_per_piece: int = PIECE_ROWS) -> tuple[DataFrame, Column | None]:
    """A table of value counts, computed once, and the chunk for its running
    totals: the pieces along ``order``, or None when the whole table is
    counted to fit in one piece."""
    per = written(per, "counts")
    if per.count() <= rows_per_piece:
        return per, None
    return ordered_pieces(per, order, rows_per_piece), F.col("_piece")


def global_index(df: DataFrame, order: Sequence[str], out: str = "rn", rows_per_piece: int = PIECE_ROWS) -> DataFrame:
    """1-based row index in ``order``: the place in its piece plus the rows
    of earlier pieces (one row per piece)."""
    pieces = ordered_pieces(df, order, rows_per_piece)
    w = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = (pieces.groupBy("_piece").agg(F.count("*").alias("_n"))
              .select("_piece", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")))
    r = pieces.join(before, "_piece")
    return r.withColumn(out, F.col("_before") + F.col("_pos") + 1).drop("_piece", "_pos", "_before")


# ---------------------------------------------------------------------------
# W1-W3
# ---------------------------------------------------------------------------
def expanding_mean(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                   out: str = "lag_mean", out_n: str | None = "lag_n",
                   rows_per_piece: int = KEY_ROWS) -> DataFrame:
    """Mean of earlier rows of the same key (T1): sum of earlier non-null
    values / number of earlier rows (nulls counted), null when there are
    none or when the current value is null."""
    tmp_n = out_n or f"_{out}_n"
    r = running_totals(df, keys, order, sums={f"_{out}_s": F.col(value)}, count_out=tmp_n, rows_per_piece=rows_per_piece)
    r = r.withColumn(out, F.when(F.col(value).isNotNull() & (F.col(tmp_n) > 0),
                                 div0(F.col(f"_{out}_s"), F.col(tmp_n))))
    r = r.drop(f"_{out}_s")
    return r if out_n else r.drop(tmp_n)


def lag_features(df: DataFrame, targets: Sequence[str], keysets: dict[str, Sequence[str]],
                 order: Sequence[str], peers: Sequence[str] = (), peer_keyset: str | None = None,
                 rows_per_piece: int = KEY_ROWS) -> DataFrame:
    """Expanding means for every (target, keyset), plus per-peer
    expanding means on ``peer_keyset`` and their row mean.

    One running-totals pass per keyset carries the sums of every target
    (and peer) at once: the earlier-row count is shared, since nulls are
    counted in it (T1)."""
    out = df
    peer_ks = peer_keyset or next(iter(keysets))
    for name, ks in keysets.items():
        vals = list(targets) + (list(peers) if peers and name == peer_ks else [])
        if not vals:
            continue
        r = running_totals(out, ks, order, sums={f"_s_{name}_{v}": F.col(v) for v in vals},
                           count_out=f"_n_{name}", rows_per_piece=rows_per_piece)
        n = F.col(f"_n_{name}")
        for v in vals:
            mean = F.when(F.col(v).isNotNull() & (n > 0), div0(F.col(f"_s_{name}_{v}"), n))
            if v in targets:
                r = r.withColumn(f"lag_{v}_{name}_n", n).withColumn(f"lag_{v}_{name}_mean", mean)
            if peers and name == peer_ks and v in peers:
                r = r.withColumn(f"lag_peer_{v}_mean", mean)
        out = r.drop(f"_n_{name}", *[f"_s_{name}_{v}" for v in vals])
    if peers:
        pcols = [f"lag_peer_{p}_mean" for p in peers]
        s = sum(F.coalesce(F.col(c), F.lit(0.0)) for c in pcols)
        k = sum(F.col(c).isNotNull().cast("int") for c in pcols)
        out = out.withColumn("lag_peers_avg", F.when(k > 0, div0(s, k)))
    return out


# ---------------------------------------------------------------------------
# bounded-frame windows
# ---------------------------------------------------------------------------
def _blocks_with_halo(df: DataFrame, keys: Sequence[str], place: str, halo: int, size: int, add_cols) -> DataFrame:
    """Windows that reach at most ``halo`` rows back, over blocks of ``size``
    positions (``place``, 1-based in the key): a block also gets copies of
    the ``halo`` rows before it, known by their position alone, which go
    again afterwards."""
    size = max(size, halo)
    block = F.floor((F.col(place) - 1) / size)
    near_end = F.pmod(F.col(place) - 1, F.lit(size)) >= size - halo
    both = df.withColumn("_own", block).withColumn("_block", F.explode(F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy(*keys, "_block").orderBy(place)
    out = both.select("*", *[e.alias(n) for n, e in add_cols(w).items()])
    return out.where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def bounded_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int, add_cols,
                   rows_per_piece: int = KEY_ROWS) -> DataFrame:
    """Windows whose frames reach at most ``halo`` rows back:
    ``add_cols(window_spec)`` returns {name: window expr}.  Keys with more
    than ``rows_per_piece`` rows run over blocks of that many rows."""
    light, heavy = split_heavy(df, keys, rows_per_piece)
    out = light.select("*", *[e.alias(n) for n, e in add_cols(Window.partitionBy(*keys).orderBy(*_cols(order))).items()])
    if heavy is None:
        return out
    cut = key_pieces(heavy, keys, order, rows_per_piece).withColumnRenamed("_piece", "_chunk")
    placed = _chunked_totals(cut, keys, ["_pos"], {}, "_place", True).drop("_chunk", "_pos")
    return out.unionByName(_blocks_with_halo(placed, keys, "_place", halo, rows_per_piece, add_cols).drop("_place"))


# ---------------------------------------------------------------------------
# W4-W7, W9
# ---------------------------------------------------------------------------
def lags(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
         ks: Sequence[int] = (1, 2), prefix: str = "lag", rows_per_piece: int = KEY_ROWS) -> DataFrame:
    """``lag(value, k)`` per key."""
    return bounded_window(df, keys, order, max(ks), lambda w: {f"{prefix}_{k}": F.lag(value, k).over(w) for k in ks}, rows_per_piece)


def ema_frame(span: float) -> int:
    """Rows after which a contribution, (1 - alpha)^rows, is below 1e-18
    and so out of a double's reach: the frame gives what the full recursion
    gives, for any span."""
    a = 2.0 / (span + 1)
    return 2 if a >= 1 else max(2, math.ceil(math.log(1e-18) / math.log1p(-a)))


def _decay(w_block: Window, w_key: Window, place: Column, value: Column, span: float) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The EMA as a scan of (decay, weighted sum) pairs.  The n-th value of
    a key lies in block (n - 1) // size at offset i = (n - 1) % size.  First
    columns: the block's weighted sum up to the row and at its end, each in
    powers of 1 / (1 - alpha) from the block's start, so that no weight grows
    beyond one block's.  Second columns: the sum at the ends of the blocks
    before, a lag of whole blocks each, as many as a double can feel.  Third:
    the EMA from both.  ``size`` is the root of that reach, so a row carries
    no list and looks at about root-many lags."""
    a = 2.0 / (span + 1)
    q, size = 1.0 - a, ema_block(span)
    blocks = -(-ema_frame(span) // size)
    i = F.pmod(place - 1, F.lit(size))
    # the key's first value weighs 1, each later one alpha
    own = F.when(place == 1, value).otherwise(value * F.lit(a)) * F.pow(F.lit(1.0 / q), i)
    first = {"_up": F.sum(own).over(w_block.rowsBetween(Window.unboundedPreceding, 0)),
             "_whole": F.sum(own).over(w_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(q ** (size - 1))}
    carry = F.lit(0.0)
    for j in range(blocks, 0, -1):
        carry = carry * F.lit(q ** size) + F.coalesce(F.lag("_whole", j * size).over(w_key), F.lit(0.0))
    return first, {"_carry": carry}, F.pow(F.lit(q), i) * F.col("_up") + F.pow(F.lit(q), i + 1) * F.col("_carry")


def ema_block(span: float) -> int:
    return max(16, math.ceil(math.sqrt(ema_frame(span))))


def ema(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], span: float = 4, out: str = "ema",
        inclusive: bool = False, rows_per_piece: int = KEY_ROWS) -> DataFrame:
    """EMA (adjust=False, alpha = 2/(span+1)) of the *previous* values (T28),
    or with ``inclusive`` up to the row's own.  Nulls are left out: they
    neither count as values nor decay earlier ones; null before the first
    value.  A span of 1 or less is the last value."""
    keys, names = list(keys), df.columns
    size, halo = ema_block(span), ema_block(span) * -(-ema_frame(span) // ema_block(span))
    up_to = Window.unboundedPreceding, Window.currentRow if inclusive else -1
    x = F.col(value).cast("double")

    def scan(rows: DataFrame, by: list[str]) -> DataFrame:
        """``_ema`` after each row; rows have ``_nth``, the value's place in its key."""
        wb = Window.partitionBy(*by, "_b").orderBy("_nth")
        first, second, value_of = _decay(wb, Window.partitionBy(*by).orderBy("_b", "_nth"), F.col("_nth"), x, span)
        rows = rows.withColumn("_b", F.floor((F.col("_nth") - 1) / size)).select("*", *[e.alias(n) for n, e in first.items()])
        if by == whole:
            rows = rows.select("*", *[e.alias(n) for n, e in second.items()])
        else:
            rows = _blocks_with_halo(rows, by, "_nth", halo, max(rows_per_piece // halo, 1) * halo,
                                     lambda w: _decay(wb, w, F.col("_nth"), x, span)[1])
        return rows.withColumn("_ema", value_of)

    light, heavy = split_heavy(df, keys, rows_per_piece)
    whole = [*keys, "_none"]  # values and nulls are windows of their own, so that lags count values only
    placed = light.withColumn("_none", F.col(value).isNull())
    placed = placed.withColumn("_nth", F.row_number().over(Window.partitionBy(*whole).orderBy(*_cols(order))))
    done = placed.withColumn("_ema", x) if span <= 1 else scan(placed, whole)
    done = done.withColumn("_ema", F.when(~F.col("_none"), F.col("_ema")))
    w = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(*up_to)
    result = done.select(*names, F.last("_ema", ignorenulls=True).over(w).alias(out))
    if heavy is None:
        return result
    cut = key_pieces(heavy, keys, order, rows_per_piece).withColumnRenamed("_piece", "_chunk")
    some, none = cut.where(F.col(value).isNotNull()), cut.where(F.col(value).isNull()).withColumn("_ema", F.lit(None).cast("double"))
    some = some.withColumn("_ema", x) if span <= 1 else scan(_chunked_totals(some, keys, ["_pos"], {}, "_nth", True), keys)
    every = some.select(*none.columns).unionByName(none)
    # the last value of the piece so far, else of the pieces before
    at = [*keys, "_chunk"]
    per = every.groupBy(*at).agg(F.max_by("_ema", F.when(F.col("_ema").isNotNull(), F.col("_pos"))).alias("_end"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*[F.col(c).alias(f"_j_{c}") for c in at], F.last("_end", ignorenulls=True).over(wc).alias("_before"))
    wi = Window.partitionBy(*at).orderBy("_pos").rowsBetween(*up_to)
    every = every.withColumn("_in", F.last("_ema", ignorenulls=True).over(wi))
    joined = every.join(before, _same(every, before, at, "_j_"), "left")
    return result.unionByName(joined.select(*names, F.coalesce("_in", "_before").alias(out)))


def rolling_prev(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                 n: int = 4, out: str = "rolling_mean", rows_per_piece: int = KEY_ROWS) -> DataFrame:
    """Mean of the previous ``n`` values, at least one."""
    return bounded_window(df, keys, order, n, lambda w: {out: F.avg(value).over(w.rowsBetween(-n, -1))}, rows_per_piece)


def weeks_since_start(df: DataFrame, date: str, out: str = "weeks_since_start") -> DataFrame:
    """floor(days since the table's first date / 7); the first date is a
    scalar subquery, not an unpartitioned window."""
    first = df.agg(F.min(F.to_date(date))).scalar()
    return df.withColumn(out, F.floor(F.datediff(F.to_date(date), first) / 7).cast("bigint"))


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    salt_buckets: int = 32, out: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order`` (a list of sort expressions),
    skew-safe: rows are first ranked inside (key, salt) buckets, so a hot
    key is cut down by many tasks before the final per-key rank."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    stage1 = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= n).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    col = out or "_rn"
    res = stage1.withColumn(col, F.row_number().over(w2)).where(F.col(col) <= n)
    return res if out else res.drop(col)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
              out: str = "rn_desc") -> DataFrame:
    """The last ``n`` rows of each series (rn_desc = 1 is the latest)."""
    return top_n_per_group(df, keys, [F.col(c).desc() for c in order], n, out=out)


def dedupe(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key, the last (or first) by ``arrival``; nulls arrive
    before all values, and rows equal in ``arrival`` leave any one of them.

    The row number is limited to 1, which Spark also applies before the
    shuffle (a window group limit): a task hands on one row per key, so a
    hot key never meets whole in one task, and no aggregate carries rows.
    """
    order = [F.col(c).desc_nulls_last() if keep == "last" else F.col(c).asc_nulls_first() for c in arrival]
    w = Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)]))
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


# ---------------------------------------------------------------------------
# W10, W11
# ---------------------------------------------------------------------------
def trend(df: DataFrame, entity: str, date: str, value: str, lookback: int = 6,
          min_rows: int = 5, clip: float = 0.05, out: str = "trend") -> DataFrame:
    """Per entity: slope of the last ``lookback+1`` monthly means over
    their index, divided by their mean, clipped to +-clip; 0 with fewer
    than 3 months or a non-positive mean; entities with fewer than
    ``min_rows`` rows use the whole table's months (T30)."""
    m = F.trunc(F.to_date(date), "month")

    def slope_of(monthly: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.col("_m").desc())
        last = monthly.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= lookback + 1)
        w2 = Window.partitionBy(*keys).orderBy("_m")
        last = last.withColumn("_i", (F.row_number().over(w2) - 1).cast("double"))
        g = last.groupBy(*keys).agg(F.regr_slope("_mv", "_i").alias("_slope"),
                                    F.avg("_mv").alias("_mean"), F.count("*").alias("_k"))
        return g.select(*keys, F.when((F.col("_k") < 3) | (F.col("_mean") <= 0), F.lit(0.0))
                        .otherwise(F.greatest(F.least(div0(F.col("_slope"), F.col("_mean")), F.lit(clip)),
                                              F.lit(-clip))).alias(out))

    per_ent = df.groupBy(entity, m.alias("_m")).agg(F.avg(value).alias("_mv"), F.count("*").alias("_n"))
    sizes = per_ent.groupBy(entity).agg(F.sum("_n").alias("_rows"))
    ent = slope_of(per_ent, [entity])
    glob = slope_of(df.groupBy(m.alias("_m")).agg(F.avg(value).alias("_mv")).withColumn("_g", F.lit(1)), ["_g"])
    gval = glob.select(out).scalar()
    return (sizes.join(ent, entity, "left")
            .select(entity, F.when(F.col("_rows") < min_rows, gval).otherwise(F.col(out)).alias(out)))


def autocorr(df: DataFrame, value: str, index: str, lags: int = 10) -> DataFrame:
    """Lag-k autocorrelation of a series with a dense integer ``index``
    (e.g. day number) for k = 1..lags, with the +-1.96/sqrt(n) band.

    The lag is an equi self-join on ``index + k``, so nothing runs as an
    unpartitioned window.
    """
    base = df.select(F.col(index).alias("_i"), F.col(value).alias("_x"))
    n = base.agg(F.count("_x")).scalar()
    shifted = (base.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags))))
               .select("lag", (F.col("_i") + F.col("lag")).alias("_i"), F.col("_x").alias("_y")))
    j = base.join(shifted, "_i")
    return (j.groupBy("lag").agg(F.corr("_x", "_y").alias("acf"))
            .withColumn("band", F.lit(1.96) / F.sqrt(n.cast("double"))))


# ---------------------------------------------------------------------------
# W15, W16, K7
# ---------------------------------------------------------------------------
def date_cut(df: DataFrame, date: str, frac: float = 0.2) -> Column:
    """Scalar (subquery) Column: the date at row index rint((n-1)*(1-frac))
    of the sorted dates (nearest-rank quantile, half to even) (T3)."""
    d = F.to_date(date)
    per_day = df.groupBy(d.alias("_d")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_t"))
    q = 1.0 - frac
    # index of the wanted row (0-based), banker's rounding like numpy rint
    idx = total.select(F.bround((F.col("_t") - 1) * F.lit(q), 0).cast("bigint")).scalar()
    w = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per_day.withColumn("_cum", F.sum("_n").over(w))  # one row per day: bounded
    return cum.where(F.col("_cum") > idx).agg(F.min("_d")).scalar()


def split_by_date(df: DataFrame, date: str, frac: float = 0.2, out: str = "split") -> DataFrame:
    cut = date_cut(df, date, frac)
    return df.withColumn(out, F.when(F.to_date(date) < cut, "train").otherwise("test"))


def split_by_row(df: DataFrame, order: Sequence[str], frac: float = 0.2, out: str = "split") -> DataFrame:
    """T4: first floor(n*(1-frac)) rows in ``order`` are train."""
    n = df.agg(F.count("*")).scalar()
    r = global_index(df, order, out="_rn")
    return (r.withColumn(out, F.when(F.col("_rn") <= F.floor(n * F.lit(1.0 - frac)), "train")
                         .otherwise("test")).drop("_rn"))


def time_folds(df: DataFrame, order: Sequence[str], k: int = 4) -> DataFrame:
    """Expanding-window folds like a time-series split with ``k``
    splits.  Output: the input rows plus ``fold`` (1..k) and ``role``
    (train/test); rows that serve several folds appear once per fold."""
    n = df.agg(F.count("*")).scalar()
    r = global_index(df, order, out="_rn")
    size = F.floor(n / F.lit(k + 1))
    start = n - F.lit(k) * size + (F.col("fold") - 1) * size  # 0-based start of test
    x = r.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    x = x.withColumn("role", F.when(F.col("_rn") - 1 < start, "train")
                     .when(F.col("_rn") - 1 < start + size, "test"))
    return x.where(F.col("role").isNotNull()).drop("_rn")


def prefix(df: DataFrame, order: Sequence[str], frac: float) -> DataFrame:
    """K7: the earliest int(n*frac) rows."""
    n = df.agg(F.count("*")).scalar()
    r = global_index(df, order, out="_rn")
    return r.where(F.col("_rn") <= F.floor(n * F.lit(frac))).drop("_rn")
