"""Centroid clustering, hard negatives and nearest neighbours against brute
force, on the given vectors and on rows with every odd case."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

from ratecast.llm import hadamard, queries, robust_graph, threshold_lists

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")
NAN, INF = float("nan"), float("inf")


def odd_rows(dim=64, n=260, seed=3):
    """Vectors with copies, ties, repeated rows, null and non-finite parts, several lengths."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, dim)], int(i % 3)) for i in range(n)]
    rows += [(n + i, rows[5][1], int(i % 4)) for i in range(60)]                 # one vector, many ids
    rows += [rows[0], rows[100], rows[100], (200, rows[7][1], None)]             # repeated rows, a shared id, no label
    rows += [(1000, None, 1), (1100, [], 1), (1200, [0.0] * dim, 2), (1201, [NAN] + [0.1] * (dim - 1), 0), (1300, [INF] + [0.1] * (dim - 1), 0),
             (1400, [None] + [0.1] * (dim - 1), 0), (None, [0.2] * dim, 1), (1500, [0.5, 0.25], 1), (1501, [0.5, 0.5], 1), (1502, [0.4, 0.125], 2)]
    return rows


def good(v, nonzero=False):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and (any(v) or not nonzero)


def frame(spark, rows, extra=True):
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    if extra:  # names that the operators use inside
        from pyspark.sql import functions as F
        for c in ("shard", "turn", "place", "v", "dim", "cluster", "score", "rank", "distance"):
            f = f.withColumn(c, F.lit("x"))
    return f.repartition(5)


def brute_clusters(rows, k=8, rounds=10, scale=1024):
    kept = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v, i) for i, v, _ in rows if len(v or []) == 64 and good(v)),
                  key=lambda r: r[:2])
    x = [[int(np.floor(scale * c)) for c in v] for _, v, _ in kept]
    centres = x[:k]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres)) for p in x]

    for _ in range(rounds):
        where = assign()
        centres = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [p for p, (_, j) in zip(x, where) if j == c]) else old
                   for c, old in enumerate(centres)]
    where = assign()
    inertia = {c: sum(d for d, j in where if j == c) for c in range(len(centres))}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((-1 if i is None else i, j, d, inertia[j], sum(inertia.values()), name[j]) for (_, _, i), (d, j) in zip(kept, where))


def got_clusters(df):
    return sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in df.collect())


def test_clusters_of_the_table(spark):
    e = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    assert got_clusters(queries.op11_centroids(spark, SF)) == brute_clusters(e)


@pytest.mark.parametrize("factor", [1.0, 3e4])
def test_clusters_of_odd_rows(spark, factor):
    rows = [(i, None if v is None else [None if x is None else x * factor for x in v], n) for i, v, n in odd_rows()]
    assert got_clusters(hadamard.clusters(frame(spark, rows))) == brute_clusters(rows)


def test_few_and_no_vectors(spark):
    rows = odd_rows()[:3]
    assert got_clusters(hadamard.clusters(frame(spark, rows))) == brute_clusters(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for run in (hadamard.clusters, threshold_lists.hard_negatives, robust_graph.neighbours):
        assert run(empty).collect() == []


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-1000, 1000, (50, 64)), rng.integers(-1000, 1000, (50, 64))
    d = hadamard.transform(x) - hadamard.transform(y)
    assert ((d * d).sum(axis=1) == 64 * ((x - y) ** 2).sum(axis=1)).all()
    assert (hadamard.transform(np.ones((1, 64), np.int64))[0, 1:] == 0).all()


def test_search_leaves_out_worse_centroids():
    """Smooth vectors (energy in the coarse coefficients) need a part of the differences."""
    rng = np.random.default_rng(2)
    centres = np.repeat(rng.integers(-1000, 1000, (8, 4)), 16, axis=1)
    x = centres[rng.integers(0, 8, 500)] + rng.integers(-20, 20, (500, 64))
    best, d, taken = hadamard.nearest(hadamard.transform(x), hadamard.transform(centres))
    full = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert taken < 0.4 * full.size * 64


def brute_negatives(rows, every=100):
    use = [(i, n, [int(np.floor(256 * x)) for x in v], at) for at, (i, v, n) in enumerate(rows) if i is not None and n is not None and good(v)]
    out = []
    for i, n, a, at in use:
        if i % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(a, b)), j, m) for j, m, b, o in use if o != at and len(a) == len(b))
        for s, j, _ in [x for x in score if x[2] == n][:5]:
            hit = [x for x in score if x[2] != n and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(hit, 1)]
    return sorted(out)


def test_negatives_of_the_table(spark):
    e = duckdb.sql(f"SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END FROM '{SF}/embeddings.parquet'").fetchall()
    want = brute_negatives(e)
    assert want and sorted(map(tuple, queries.op12_negatives(spark, SF).collect())) == want


@pytest.mark.parametrize("factor", [1.0, 1e6])
@pytest.mark.parametrize("sizes", [(8192, 32768), (50, 4)])
def test_negatives_of_odd_rows(spark, factor, sizes):
    rows = [(i, None if v is None else [None if x is None else x * factor for x in v], n) for i, v, n in odd_rows(dim=6)]
    want = brute_negatives(rows, every=20)
    got = threshold_lists.hard_negatives(frame(spark, rows), every=20, shard_rows=sizes[0], block=sizes[1])
    assert want and sorted(map(tuple, got.collect())) == want


def test_threshold_stops_early():
    """Where a few rows stand out, most are never scored."""
    rng = np.random.default_rng(4)
    x = rng.integers(-20, 20, (5000, 8)).astype(float)
    x[:6] += 300
    lists, none = threshold_lists.Lists(x, np.arange(5000)), np.zeros(5000, bool)
    [(score, row)], scored = lists.best(np.ones(8), [(None, None)], 5, none)
    full = x.sum(axis=1)
    assert row.tolist() == np.lexsort((np.arange(5000), -full))[:5].tolist() and (score == full[row]).all()
    assert scored < 500
    [(score, row)], _ = lists.best(np.zeros(8), [(None, None)], 5, none)
    assert row.tolist() == [0, 1, 2, 3, 4] and not score.any()


def brute_neighbours(rows, k=10, every=100):
    use = [(i, v, at) for at, (i, v, _) in enumerate(rows) if i is not None and good(v, True)]
    out = {}
    for i, v, at in use:
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.array(b) - np.array(v)) ** 2).sum())), j) for j, b, o in use if o != at and len(b) == len(v))
            out.setdefault(i, []).append(near[:k])
    return out


def recall(got, want, rows):
    """Share of the true neighbours' distances reached; scores are checked exactly."""
    vectors = {}
    for i, v, _ in rows:
        vectors.setdefault(i, []).append(v)
    found = {}
    for q, rank, j, s in sorted(map(tuple, got), key=lambda r: r[:2]):
        assert any(len(a) == len(b) and abs(s - np.sqrt(((np.array(a, float) - np.array(b, float)) ** 2).sum())) < 1e-12 * max(1, s)
                   for a in vectors[q] if good(a, True) for b in vectors[j] if good(b, True))
        found.setdefault(q, []).append((s, j))
    hit = total = 0
    for q, lists in want.items():
        mine = sorted(found.get(q, []))
        assert len(mine) == sum(map(len, lists))
        true = sorted(p for one in lists for p in one)
        total += len(true)
        hit += len(set(mine) & set(true)) if len(lists) == 1 else sum(m == t for m, t in zip(mine, true))
    return hit / total


@pytest.mark.parametrize("sizes", [(8192, 32768), (70, 2)])
def test_neighbours_of_odd_rows(spark, sizes):
    rows = odd_rows(dim=12)
    got = robust_graph.neighbours(frame(spark, rows), every=20, shard_rows=sizes[0], block=sizes[1]).collect()
    want = brute_neighbours(rows, every=20)
    assert recall(got, want, rows) >= 0.9
    for q in (q for q, lists in want.items() if len(lists) == 1):
        mine = sorted(tuple(r)[1:] for r in got if r[0] == q)
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        assert [(s, j) for _, j, s in mine] == sorted((s, j) for _, j, s in mine)


def test_neighbours_of_the_table(spark):
    e = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    assert recall(queries.op13_neighbours(spark, SF).collect(), brute_neighbours(e), e) >= 0.9


def test_graph_recall_without_audit():
    """A graph of 4,096 vectors, narrow beam: the pruned edges carry the search."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (64, 24))[rng.integers(0, 64, 4096)] + rng.normal(0, 0.4, (4096, 24))
    g = robust_graph.Graph(v).build(robust_graph.DEGREE, robust_graph.ALPHA, robust_graph.BUILD_BEAM)
    assert (g.near >= 0).sum(axis=1).max() <= robust_graph.DEGREE
    q = g.x[:200]
    found, true = g.search(q, 64)[0][:, :10], g.exact(q, 10)
    assert np.mean([len(np.intersect1d(a, b)) for a, b in zip(found, true)]) >= 9.3
