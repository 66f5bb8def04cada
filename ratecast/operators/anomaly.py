"""Isolation-forest anomaly scores (survey M26).

* A row draws the number of trees it enters (binomial, by a seeded hash of
  its id) and then that many trees, so most rows of a large table are never
  copied; of a tree's draws the ``sample`` with the smallest hashes are
  taken, so every tree's group is bounded no matter how large the table is.
* Trees are grown with ``applyInPandas`` grouped by tree id (one small
  numpy task per tree) and come back as node rows: at most
  trees x (2*sample - 1) of them, a proven bound, so they are broadcast.
  A leaf holds its path value, its depth plus the mean path of its rows.
* Scoring is ``mapInArrow`` over the rows to score: vectorised numpy
  traversal of every tree per Arrow batch, a fixed number of steps a tree;
  the other columns pass as they are.  The cut-off is the exact
  quantile of the train scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecast.operators.quantiles import quantiles

_NODE_SCHEMA = ("tree long, node long, feature long, threshold double, left long, right long, "
                "path double")


def _c(n: float) -> float:
    """Average unsuccessful-search path length in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(cols: Sequence[str], max_depth: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + tree)
        x = pdf[list(cols)].to_numpy(dtype="float64")
        rows = []
        stack = [(0, np.arange(len(x)), 0)]
        next_id = 1
        while stack:
            node, idx, depth = stack.pop()
            sub = x[idx]
            lo, hi = (sub.min(axis=0), sub.max(axis=0)) if len(idx) else (None, None)
            splittable = [] if lo is None else np.flatnonzero(hi > lo)
            if depth >= max_depth or len(idx) <= 1 or len(splittable) == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, depth + _c(len(idx))))
                continue
            f = int(rng.choice(splittable))
            t = float(rng.uniform(lo[f], hi[f]))
            left, right = next_id, next_id + 1
            next_id += 2
            rows.append((tree, node, f, t, left, right, 0.0))
            stack.append((left, idx[sub[:, f] < t], depth + 1))
            stack.append((right, idx[sub[:, f] >= t], depth + 1))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    return grow


def binomial_cdf(n: int, p: float, tail: float = 1e-12) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where less than ``tail`` is left."""
    out, term, total = [], (1.0 - p) ** n, 0.0
    for k in range(n + 1):
        total += term
        out.append(total)
        if total >= 1.0 - tail:
            break
        term *= (n - k) / (k + 1) * p / (1.0 - p)
    return out


def draw_trees(rows: DataFrame, n: int, id_col: str, trees: int, sample: int, seed: int) -> DataFrame:
    """``rows`` with ``_tree``, once per tree drawn: about 3 * ``sample`` per
    tree, or all rows for every tree where there are no more than that."""
    p = 3.0 * sample / max(n, 1)
    if p >= 1.0:
        return rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = lambda *of: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 1) / F.lit(float(1 << 63))
    u = draw(F.col(id_col))
    many = F.size(F.filter(F.array(*[F.lit(c) for c in binomial_cdf(trees, p)]), lambda c: c <= u))
    drawn = rows.withColumn("_many", many).where(F.col("_many") > 0)
    # the j-th of ``_many`` trees lies in the j-th of as many equal shares of them, so no tree comes twice
    drawn = drawn.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)))
    at = draw(F.col(id_col), F.col("_j"))
    low, high = F.floor(F.col("_j") * trees / F.col("_many")), F.floor((F.col("_j") + 1) * trees / F.col("_many"))
    return drawn.withColumn("_tree", F.least(low + F.floor(at * (high - low)), high - 1).cast("int")).drop("_many", "_j")


def fit_isolation_forest(train: DataFrame, cols: Sequence[str], id_col: str, trees: int = 200, sample: int = 256,
                         seed: int = 42) -> pd.DataFrame:
    """Grow the forest; returns the node table (bounded: trees x (2*sample-1))."""
    n = train.agg(F.count("*")).first()[0]
    x = train.select(F.col(id_col).cast("bigint").alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    x = draw_trees(x, n, "_id", trees, sample, seed)
    x = x.withColumn("_u", F.xxhash64(F.lit(seed), F.lit("rank"), "_id", "_tree"))
    w = Window.partitionBy("_tree").orderBy("_u", "_id")  # ~3*sample rows per tree: bounded groups
    x = x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample).drop("_r", "_u")
    max_depth = int(np.ceil(np.log2(sample)))
    nodes = x.groupBy("_tree").applyInPandas(_grow(cols, max_depth, seed), _NODE_SCHEMA)
    return nodes.toPandas()  # bounded by trees x (2*sample - 1) rows


def score_isolation_forest(df: DataFrame, nodes: pd.DataFrame, cols: Sequence[str], sample: int = 256,
                           out: str = "anomaly_score") -> DataFrame:
    """Anomaly score 2^(-E[path length] / c(sample)) per row."""
    trees = sorted(nodes["tree"].unique())
    packed = []
    for t in trees:
        nd = nodes[nodes["tree"] == t].sort_values("node")
        at, size = nd["node"].to_numpy(), int(nd["node"].max()) + 1
        leaf = nd["feature"].to_numpy() < 0
        feature, child = np.zeros(size, dtype=np.int64), np.zeros(2 * size, dtype=np.int64)
        threshold, path = np.zeros(size), np.zeros(size)
        # a leaf leads to itself, so all rows of a batch take the same number of steps
        feature[at] = np.where(leaf, 0, nd["feature"])
        child[2 * at], child[2 * at + 1] = np.where(leaf, at, nd["right"]), np.where(leaf, at, nd["left"])
        threshold[at], path[at] = nd["threshold"], nd["path"]
        depth = dict.fromkeys([0], 0)
        for n in sorted(at.tolist()):  # children come after their parent
            depth.update({c: depth[n] + 1 for c in child[2 * n:2 * n + 2].tolist() if c != n})
        packed.append((feature, threshold, child, path, max(depth.values())))
    bc = df.sparkSession.sparkContext.broadcast(packed)
    c_norm = _c(sample)
    cols = list(cols)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])

    def score(batches):
        forest = bc.value
        for b in batches:
            n = b.num_rows
            x = np.concatenate([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols])  # one column after another
            rows, total = np.arange(n), np.zeros(n)
            for feature, threshold, child, path, depth in forest:
                node = np.zeros(n, dtype=np.int64)
                for _ in range(depth):
                    left = x.take(feature.take(node) * n + rows) < threshold.take(node)
                    node = child.take(2 * node + left)
                total += path.take(node)
            found = np.power(2.0, -(total / len(forest)) / c_norm)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, out])

    return df.mapInArrow(score, schema)


def isolation_forest(train: DataFrame, test: DataFrame, cols: Sequence[str], id_col: str, trees: int = 200,
                     sample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Fit on train, score test; rows above the train (1 - contamination)
    score quantile are anomalies."""
    nodes = fit_isolation_forest(train, cols, id_col, trees, sample, seed)
    thr = quantiles(score_isolation_forest(train, nodes, cols, sample), "anomaly_score", [1 - contamination])[0]
    return score_isolation_forest(test, nodes, cols, sample).withColumn("is_anomaly", F.col("anomaly_score") > thr)
