"""Clustering around integer centroids by Walsh-Hadamard progressive search.

Components become integers floor(scale * x).  The Walsh-Hadamard transform
of 64 integers is exact and keeps squared distances up to the factor 64.
A vector's coefficient differences to all centroids are accumulated from
coarse to fine (by sequency, in blocks).  After the first block the
centroid that leads is finished, and each centroid whose partial sum
already exceeds that distance is strictly worse and goes; those that stay
are accumulated through all 64 coefficients, and equal distances go to the
smaller number.

Each round is one pass over the vectors: a task adds up its vectors per
centroid and hands on one row per centroid, so that only ``k`` sums reach
the driver.  The input is read once a round and no copy of it is written,
so give it a table rather than a costly plan.  A round that changes no
centroid ends the rounds, since all later ones would repeat it.

Defined cases: vectors that are null, have other than 64 components, or
hold a null or non-finite one are not kept and have no row; repeated rows
are vectors of their own; rows without an id are clustered, but start no
centroid while others can; fewer kept vectors than ``k`` give as many
centroids; no kept vector, no row; only ``vec_id`` and ``embedding`` are
read.  Integers of any size are exact (beyond 2^24 by Python's integers);
a distance that no long holds raises an error.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch
from ratecast.llm.vector_blocks import usable

SIZE = 64
STEPS = (4, 8, 16, 32, 64)  # ends of the blocks of coefficients
EXACT = 1 << 24             # largest integer whose squared differences of coefficients fit 64 bits in sum


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where those are too narrow."""
    v = np.floor(v * scale)
    return v.astype(np.int64) if not v.size or np.abs(v).max() <= EXACT else np.array([[int(x) for x in r] for r in v], dtype=object)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of 64 integers, coarse to fine."""
    w, half = x.copy(), 1
    while half < SIZE:
        pairs = w.reshape(len(w), -1, 2, half)
        w = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(w), SIZE)
        half *= 2
    return w[:, _sequency()]


def _sequency() -> np.ndarray:
    """Order of the coefficients by their functions' number of sign changes."""
    i = np.arange(SIZE)
    signs = np.bitwise_count(i[:, None] & i) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1))


def nearest(coef: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row of coefficients, and how many
    differences of coefficients were taken."""
    n, rows = len(coef), np.arange(len(coef))
    part = np.zeros((n, len(centres)), dtype=coef.dtype)
    alive, begin, taken = np.ones(part.shape, bool), 0, 0
    for end in STEPS:
        r, c = np.nonzero(alive)
        d = coef[r, begin:end] - centres[c, begin:end]
        part[r, c] += (d * d).sum(axis=1)
        taken += d.size
        if begin == 0:
            lead = part.argmin(axis=1)
            d = coef[:, end:] - centres[lead, end:]
            bound = part[rows, lead] + (d * d).sum(axis=1)
            taken += d.size
            alive[rows, lead] = False  # finished
        alive &= part <= bound[:, None]
        begin = end
    # the leader's sum stands at its first block: give it its whole distance
    part[rows, lead] = bound
    alive[rows, lead] = True
    worst = part.max() + 1
    best = np.where(alive, part, worst).argmin(axis=1)
    return best, part[rows, best] // SIZE, taken


def _vectors(batch, column: int, scale: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(-1, SIZE), scale)


def _centres(x: list[list[int]], like: np.ndarray) -> np.ndarray:
    return transform(np.array(x, dtype=object)).astype(like.dtype) if len(x) else np.empty((0, SIZE), like.dtype)


def _fitting(x: np.ndarray, centres: list[list[int]]) -> np.ndarray:
    """``x`` in a type that also holds the centroids exactly."""
    big = max((abs(v) for c in centres for v in c), default=0) > EXACT
    return x.astype(object) if big else x


def _sums(rows: DataFrame, centres: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (vectors, sums of their components)}, for those with vectors."""

    def run(batches):
        count, total = [0] * len(centres), [np.zeros(SIZE, dtype=object) for _ in centres]
        for batch in batches:
            x = _fitting(_vectors(batch, 0, scale), centres)
            best, _, _ = nearest(transform(x), _centres(centres, x))
            for c in np.unique(best).tolist():
                mine = x[best == c]
                count[c] += len(mine)
                total[c] = total[c] + mine.sum(axis=0)
        have = [c for c, n in enumerate(count) if n]
        if have:
            yield pa.RecordBatch.from_arrays(
                [pa.array(have, pa.int32()), pa.array([count[c] for c in have], pa.int64()),
                 pa.array([[Decimal(int(s)) for s in total[c]] for c in have], pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "s"])

    per_task = rows.select("embedding").mapInArrow(run, "cluster int, n long, s array<decimal(38,0)>")
    sums = per_task.select("cluster", "n", F.posexplode("s").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.collect():  # 64 rows a centroid
        out.setdefault(r["cluster"], (r["n"], [0] * SIZE))[1][r["i"]] = int(r["s"])
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    per kept vector.  The start is the ``k`` vectors with the smallest
    SHA-256 of ``seed:vec_id``; means are floors of exact quotients."""
    spark = vectors.sparkSession
    double = F.transform("embedding", lambda c: c.cast("double"))
    kept = vectors.where(usable() & (F.size("embedding") == SIZE)).select(F.col("vec_id").alias("vec_id"), double.alias("embedding"))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "embedding").limit(k)
    centres = [[int(x) for x in integers(np.array([r["embedding"]]), scale)[0]] for r in first.collect()]
    for _ in range(rounds):
        found = _sums(kept, centres, scale)
        new = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centres)]
        if new == centres:
            break
        centres = new

    def run(batches):
        for batch in batches:
            x = _fitting(_vectors(batch, 1, scale), centres)
            best, distance, _ = nearest(transform(x), _centres(centres, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(distance.tolist(), pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    placed = Scratch(spark, "clusters").write(kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "placed")
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), name[c]) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3") -> str:
    """The same in DuckDB's SQL."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.n, b.c, "
            f"list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS d FROM v, b{r} b) GROUP BY n)")
        if r < rounds:
            steps.append(
                f"s{r} AS MATERIALIZED (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT a.c, i.i, v.x[i.i] AS x "
                f"FROM a{r} a JOIN v USING (n), range(1, 65) i(i)) GROUP BY c, i), "
                f"m{r} AS MATERIALIZED (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS x FROM s{r} GROUP BY c), "
                f"b{r + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (c))")
    last = f"a{rounds}"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, embedding,
  list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), embedding) - 1 AS c, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), embedding) <= {k}),
{", ".join(steps)}
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(b.x, ',')) AS centroid_sha256
FROM {last} a JOIN v USING (n) JOIN b{rounds} b ON b.c = a.c"""


SQL = sql()
