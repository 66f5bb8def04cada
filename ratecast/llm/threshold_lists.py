"""Hard negatives by Fagin's threshold algorithm.

Components become integers floor(scale * x), so that all scores (inner
products) are exact.  Rows are dealt into shards; a shard keeps one sorted
candidate list per dimension.  For an anchor the lists are read at equal
depth, from the largest value where the anchor's component is positive and
from the smallest where it is negative (sorted access); each row met for
the first time is scored in whole (random access).  The anchor's components
times the values at the present depth add up to the threshold, which no row
not yet met can exceed.  A window of scores is settled once the threshold
falls strictly below its k-th score, or below its lower end; rows that tie
with the k-th have then all been met.

Two passes use it: the first finds each anchor's positives among the rows
of its label (one window without ends), the second the negatives of each
positive's window among the rows of other labels.  A shard returns at most
k rows a window, and these are ranked together.  Anchors meet shards in
blocks, each in a task of its own.

Defined cases: rows with a null id or label, or with a vector that is null,
empty or holds a null or non-finite component take no part; vectors of
different lengths are not compared; repeated rows are rows of their own;
ties go to the smaller id; an anchor without positives, and a positive
without negatives, has no row; an empty table gives an empty result; only
``vec_id``, ``embedding`` and ``label`` are read.  Integers of any size are
exact; a score that no long holds raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch
from ratecast.llm.vector_blocks import blocks, dealt, matrix, meet, shard, usable

SHARD = 8192      # rows of a shard, about
ANCHORS = 32_768  # anchors that meet a shard in one task, about
FIRST_DEPTH = 16


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit floats, in which the inner products are exact
    integers, or Python's integers where those are too narrow."""
    v = np.floor(v * scale)
    top = float(np.abs(v).max()) if v.size else 0.0
    return v if top * top * v.shape[1] < 2**53 else np.array([[int(x) for x in r] for r in v], dtype=object)


class Lists:
    """The sorted candidate lists of some rows: row numbers by ascending value."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)

    def only(self, some: np.ndarray) -> Lists:
        """The lists of the rows marked in ``some``, numbered as before."""
        part = object.__new__(Lists)
        part.x, part.ids = self.x, self.ids
        cols = self.order.T
        part.order = cols[some[cols]].reshape(cols.shape[0], -1).T
        return part

    def best(self, a: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, skip: np.ndarray) -> tuple[list, int]:
        """Per window (low, high; None is open) its first ``k`` rows as (score,
        row), highest first, ties by id; and the number of rows scored.  Rows
        marked in ``skip`` count as met."""
        n = len(self.order)
        seen = skip.copy()
        use = np.flatnonzero(a)
        use = use if len(use) else np.arange(1)  # all scores are 0: any list will do
        up, down = use[a[use] >= 0], use[a[use] < 0]
        found = [(np.empty(0, self.x.dtype), np.empty(0, np.int64)) for _ in windows]
        live, depth, step, scored = list(range(len(windows))), 0, FIRST_DEPTH, 0
        while live and depth < n:
            end = min(n, depth + step)
            new = np.zeros(len(seen), bool)
            new[self.order[n - end:n - depth, up]] = True
            new[self.order[depth:end, down]] = True
            new &= ~seen
            seen |= new
            met = np.flatnonzero(new)
            scored += len(met)
            score = self.x[met] @ a
            threshold = (a[up] * self.x[self.order[n - end, up], up]).sum() + (a[down] * self.x[self.order[end - 1, down], down]).sum()
            left = []
            for w in live:
                low, high = windows[w]
                inside = np.ones(len(met), bool)
                if low is not None:
                    inside &= (score >= low).astype(bool)
                if high is not None:
                    inside &= (score <= high).astype(bool)
                s, r = np.append(found[w][0], score[inside]), np.append(found[w][1], met[inside])
                pick = np.lexsort((r, self.ids[r], -s))[:k] if s.dtype != object else np.array(
                    sorted(range(len(s)), key=lambda i: (-s[i], self.ids[r[i]], r[i]))[:k], dtype=np.int64)
                found[w] = s[pick], r[pick]
                if not ((low is not None and threshold < low) or (len(pick) == k and threshold < s[pick[-1]])):
                    left.append(w)
            live, depth, step = left, end, step * 2
        return found, scored


def _same_type(x: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact."""
    narrow = x.dtype != object and a.dtype != object
    if narrow and (not x.size or not a.size or float(np.abs(x).max()) * float(np.abs(a).max()) * x.shape[1] < 2**53):
        return x, a

    def whole(m):
        return m if m.dtype == object else np.array([[int(v) for v in r] for r in m], dtype=object)

    return whole(x), whole(a)


_FOUND = "place long, positive int, vec_id long, row long, score long"


def _search(scale: int, k: int, same_label: bool):
    """Task of one shard and one block of anchors."""

    def run(key, rows, anchors):
        out = []
        if rows.num_rows and anchors.num_rows:
            dim = key[0].as_py()
            ids, label, place = (rows.column(c).to_numpy() for c in ("vec_id", "label", "place"))
            x, a = _same_type(integers(matrix(rows.column("v"), dim), scale), integers(matrix(anchors.column("v"), dim), scale))
            whole = Lists(x, ids)
            per_label: dict[int, Lists] = {}
            mine, own = anchors.column("label").to_numpy(), anchors.column("place").to_numpy()
            windows = [[(None, None)]] * len(a) if same_label else [
                [(w["low"], w["high"]) for w in some] for some in anchors.column("windows").to_pylist()]
            for i in np.lexsort((own, mine)).tolist():
                if mine[i] not in per_label:
                    per_label = {mine[i]: whole.only((label == mine[i]) == same_label)}
                got, _ = per_label[mine[i]].best(a[i], windows[i], k, place == own[i])
                out += [(own[i], w, ids[r], place[r], int(s)) for w, (score, at) in enumerate(got) for s, r in zip(score.tolist(), at.tolist())]
        cols = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(cols)], names=["place", "positive", "vec_id", "row", "score"])

    return run


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   shard_rows: int = SHARD, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): anchors are the rows whose id ``every`` divides; a
    negative's score is ``low`` to ``high`` per cent of the positive's."""
    store = Scratch(vectors.sparkSession, "negatives")
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    rows = dealt(good, store, "rows", F.col("label"))
    n = rows.count()
    shards = blocks(n, shard_rows)
    rows = rows.withColumn("shard", shard(shards))
    anchors = rows.where(F.col("vec_id") % every == 0).drop("shard")
    turns = blocks(anchors.count(), block)
    found = meet(rows, anchors, shards, turns, _search(scale, positives, True), _FOUND)
    first = store.write(_ranked(found, positives, "place").select("place", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                        "positives")
    # at most ``positives`` windows an anchor; floor and ceiling of exact quotients, in integers
    share = F.col("positive_score").cast("decimal(20,0)")
    ends = first.select("place", "rank", F.ceil(share * low / 100).cast("long").alias("low"), F.floor(share * high / 100).cast("long").alias("high"))
    windows = ends.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))),
                                                    lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    asks = store.write(anchors.join(windows, "place"), "asks")
    found = meet(rows, asks, shards, turns, _search(scale, negatives, False), _FOUND)
    last = _ranked(found, negatives, "place", "positive").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "rank": "n"})
    named = anchors.select("place", F.col("vec_id").alias("anchor_id"))
    return (last.join(first, (last.place == first.place) & (last.positive + 1 == first["rank"])).drop(first.place).join(named, "place")
            .select("anchor_id", "positive_id", F.col("n").alias("rank"), "negative_id", "positive_score", "negative_score"))


SQL = """
WITH r AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS n, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (SELECT a.n AS a, a.vec_id AS anchor_id, b.vec_id, b.n AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.n != b.n AND len(a.x) = len(b.x)),
p AS (SELECT a, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS i, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY i <= 5)
SELECT s.anchor_id, p.positive_id, row_number() OVER (PARTITION BY s.a, p.i ORDER BY s.score DESC, s.vec_id, s.b)::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
