"""Approximate nearest neighbours by robust-pruned directed graphs.

Rows are dealt into shards and each shard's distinct vectors become the
nodes of one directed graph, built once and written.  Nodes enter in
growing batches: greedy beam searches from the medoid propose neighbours,
and relaxed pruning keeps a proposal unless a kept neighbour is ``alpha``
times nearer to it than the node is, so that edges point in diverse
directions; back edges are pruned alike where a node has too many.  A
second round over all nodes searches the finished graph.  Batches are
searched together with numpy, a step of every search at a time.

Queries meet the shards in blocks, each in a task of its own.  A beam
search from the medoid finds a shard's nearest nodes; on up to ``AUDIT``
queries of the block it is held against all the shard's vectors, and the
beam doubles until their recall reaches ``RECALL`` (at last the beam is the
whole shard).  Distances of what is found are then taken on the original
vectors in double precision, copies of a vector are listed by id, and the
shards' nearest are ranked together.

Every row is indexed: copies stand behind their node.  Defined cases: rows
with a null id, or with a vector that is null, empty, zero or holds a null
or non-finite component take no part; vectors of different lengths are not
compared; repeated rows are rows of their own, and only a query's own row
is no candidate of it; ties go to the smaller id; an empty table gives an
empty result; only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch
from ratecast.llm.pruned_graph import BATCH, Graph
from ratecast.llm.vector_blocks import blocks, dealt, matrix, meet, shard, usable

SHARD = 8192       # rows of a graph, about
QUERIES = 32_768   # queries that meet a shard in one task, about
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 48
BEAM = 64
AUDIT = 64         # queries of a block and shard that are held against brute force
RECALL = 0.97


def audited(graph: Graph, q: np.ndarray, k: int, beam: int = BEAM, recall: float = RECALL) -> int:
    """The beam at which these queries find their ``k`` nearest nodes to this share."""
    k = min(k, len(graph.x))
    true = graph.exact(q, k)
    while beam < len(graph.x):
        found, _ = graph.search(q, beam)
        hit = sum(len(np.intersect1d(f[:k], t)) for f, t in zip(found, true))
        if hit >= recall * true.size:
            return beam
        beam *= 2
    return len(graph.x)


_NODES = "node int, medoid boolean, v binary, near binary, copies binary"


def _build(degree: int, alpha: float):
    def run(key, rows):
        dim, part = key[0].as_py(), key[1].as_py()
        ids, place = rows.column("vec_id").to_numpy(), rows.column("place").to_numpy()
        order = np.lexsort((place, ids))  # whatever order the rows arrive in
        raw = rows.column("v").to_pylist()
        behind: dict[bytes, list[int]] = {}
        for i in order.tolist():
            behind.setdefault(raw[i], []).append(i)
        nodes = list(behind)
        graph = Graph(matrix(pa.array(nodes, pa.binary()), dim)).build(degree, alpha, BUILD_BEAM)
        copies = [np.column_stack([ids[c], place[c]]).astype("<i8").tobytes() for c in behind.values()]
        near = [x[x >= 0].astype("<i4").tobytes() for x in graph.near]
        n = len(nodes)
        return pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([part] * n, pa.int32()), "node": pa.array(np.arange(n), pa.int32()),
                         "medoid": pa.array(np.arange(n) == graph.medoid), "v": pa.array(nodes, pa.binary()), "near": pa.array(near, pa.binary()),
                         "copies": pa.array(copies, pa.binary())})
    return run


_FOUND = "place long, vec_id long, row long, score double"


def _answer(k: int, beam: int, recall: float):
    def run(key, rows, asks):
        out = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.float64)]
        if rows.num_rows and asks.num_rows:
            dim = key[0].as_py()
            rows, asks = rows.sort_by("node"), asks.sort_by("place")
            v = matrix(rows.column("v"), dim)
            near = rows.column("near").to_pylist()
            wide = max(1, max(map(len, near)) // 4)
            table = np.full((len(v), wide), -1, np.int32)
            for i, x in enumerate(near):
                table[i, :len(x) // 4] = np.frombuffer(x, "<i4")
            graph = Graph(v, table, int(np.flatnonzero(rows.column("medoid").to_numpy(zero_copy_only=False))[0]))
            copies = rows.column("copies")
            q, own = matrix(asks.column("v"), dim), asks.column("place").to_numpy()
            scaled = (q / graph.top).astype(np.float32)
            most = k + 1  # a query's own row goes
            spread = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)
            wide = audited(graph, scaled[spread], most, beam, recall)
            found = []
            for i in range(0, len(q), BATCH):
                some = scaled[i:i + BATCH]
                ids = graph.exact(some, most) if wide >= len(v) else graph.search(some, wide)[0][:, :most]
                for j, nodes in enumerate(ids, i):
                    nodes = nodes[nodes >= 0]
                    d = np.sqrt(((v[nodes] - q[j]) ** 2).sum(axis=1))
                    pairs = [(s, *p) for s, c in zip(d.tolist(), nodes.tolist())
                             for p in np.frombuffer(copies[c].as_py(), "<i8").reshape(-1, 2)[:most].tolist()]
                    found += [(own[j], a, b, s) for s, a, b in sorted(p for p in pairs if p[2] != own[j])[:k]]
            out = list(zip(*found)) or out
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())],
                        names=["place", "vec_id", "row", "score"])
    return run


def index(rows: DataFrame, shards: int, store: Scratch, degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """The graphs of all shards, a row per distinct vector of a shard, built once and written."""
    built = rows.withColumn("shard", shard(shards)).groupBy("dim", "shard").applyInArrow(
        _build(degree, alpha), f"dim int, shard int, {_NODES}")
    return store.write(built, "graphs")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, beam: int = BEAM, recall: float = RECALL, shard_rows: int = SHARD,
               block: int = QUERIES, degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id ``every`` divides."""
    store = Scratch(vectors.sparkSession, "graphs")
    rows = dealt(vectors.where(F.col("vec_id").isNotNull() & usable(nonzero=True)), store, "rows")
    asks = rows.where(F.col("vec_id") % every == 0)
    shards, turns = blocks(rows.count(), shard_rows), blocks(asks.count(), block)
    found = meet(index(rows, shards, store, degree, alpha), asks, shards, turns, _answer(k, beam, recall), _FOUND)
    order = W.partitionBy("place").orderBy("score", "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = asks.select(F.col("place").alias("__place"), F.col("vec_id").alias("query_id"))
    return best.join(named, best.place == F.col("__place")).select("query_id", "rank", "vec_id", "score")
