"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words give k-word shingles; bit i of its fingerprint is 1 when
more than half of the shingle hashes have it set.  Two fingerprints within
d bits have a common value within ceil(d / 2) bits of both, so every
distinct fingerprint emits all such variants, variants are shuffled, and
fingerprints that meet on a variant are candidates.  One of the two lies
within floor(d / 2) of it; the smallest fingerprint that near is the centre
of a star, and it lies within d bits of all that meet there.  A pair has one
home among its common variants: from the larger one, as many of the highest
differing bits are turned as exceed floor(d / 2).  A star keeps the edges
that are at home on its variant.  This loses no connection: of a link (a, b)
with a < b, the centre at its home is a itself, or a smaller c linked to
both, and (c, a) and (c, b) are connected by the same rule, as their smaller
end decreases.  So an edge is made once, however many variants its ends
share, and every edge is verified by its bit count.

The variant space is cut into rounds by a linear syndrome (a parity of the
variant's bits, which tells from a fingerprint's and a mask's own syndrome),
so each round generates only its own variants and the disk holds one
round's shuffle: at most ``ROUND_VARIANTS``, or on large tables
``ROUND_SHARE`` per fingerprint.  Variants travel in packed blocks, one per
target bucket; emitting and meeting tasks are both sized by variants, and
their number grows with them.

Defined cases: null and empty texts have fingerprint 0 and link like any
other; a null id is never a representative unless a whole component has
none; repeated rows and shared ids stay rows of their own; an empty table
gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch, byte_runs, components, mix, partitions, row_key

SEED = 42
ROUND_VARIANTS = 64_000_000    # variants shuffled at once,
ROUND_SHARE = 64               # or as many per fingerprint, if that is more
TASK_VARIANTS = 1_000_000      # that meet in one task, about
SLICE_VARIANTS = 500_000       # generated at a time
_SYNDROME = mix(np.arange(1, 17, dtype=np.uint64))  # masks of the parities: any linearly independent ones


def _prints(words_per_text: list[list[bytes]], k: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for words in words_per_text:
        n = len(words)
        if n == 0:
            counts.append(0)
        elif n <= k:
            hashes.append(digest(b" ".join(words), SEED))
            counts.append(1)
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            starts = np.concatenate([[0], ends[:n - k]]).tolist()
            stops = (ends[k - 1:] - 1).tolist()
            hashes.extend([digest(line[a:b], SEED) for a, b in zip(starts, stops)])
            counts.append(n - k + 1)
    out = np.zeros(len(counts), np.uint64)
    counts = np.array(counts)
    if not hashes:
        return out
    h = np.array(hashes, dtype=np.uint64)
    full = np.flatnonzero(counts)
    begin = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    major = (2 * ones > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, key, fp) per row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            for a, b, texts in byte_runs(batch.column(2), 1_000_000):
                fp = _prints([t.lower().split() for t in texts], shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(fp.view(np.int64))],
                    names=["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, fp long")


def masks(radius: int) -> np.ndarray:
    """All 64-bit values with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)], dtype=np.uint64)


def _parity(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for i in range(bits):
        out |= (np.bitwise_count(x & _SYNDROME[i]) & 1).astype(np.int64) << i
    return out


def _emit(fps: np.ndarray, ball: np.ndarray, bits: int, turn: int, shift: int):
    """This round's variants of ``fps`` as (bucket, fingerprints, mask numbers), by bucket."""
    own, of_mask = _parity(fps, bits), _parity(ball, bits)
    f, m = [], []
    for s in range(1 << bits):
        some, which = fps[own == s], np.flatnonzero(of_mask == (s ^ turn)).astype(np.uint16)
        f.append(np.repeat(some, len(which)))
        m.append(np.tile(which, len(some)))
    f, m = np.concatenate(f), np.concatenate(m)
    bucket = (((f ^ ball[m]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, f, m = bucket[order], f[order], m[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, int)
    for a, b in zip(at, [*at[1:], len(bucket)]):
        yield int(bucket[a]), f[a:b].tobytes(), m[a:b].tobytes()


def _meet(f: np.ndarray, m: np.ndarray, ball: np.ndarray, near: int, distance: int) -> np.ndarray:
    """Verified star edges (centre, other), centre the smaller, that are at
    home on the variant their ends share here; masks numbered below ``near``
    reach floor(distance / 2) bits."""
    v = f ^ ball[m]
    order = np.argsort(v)
    v, f, m = v[order], f[order], m[order]
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.append(at, len(v)))
    centre = np.minimum.reduceat(np.where(m < near, f, np.uint64(2**64 - 1)), at)
    centre = np.repeat(centre, size)
    linked = centre < f
    centre, f, turned = centre[linked], f[linked], ball[m[linked]]
    differ = centre ^ f
    apart = np.bitwise_count(differ)
    rest = differ & ~turned  # at home: the turned bits differ, are the fewest that will do and lie above the rest
    home = (turned & ~differ == 0) & (np.bitwise_count(turned) == np.maximum(apart, distance // 2) - distance // 2)
    home &= (turned == 0) | (rest < (turned & (~turned + np.uint64(1))))
    return np.column_stack([centre, f])[home & (apart <= distance)]


def ball_edges(prints: DataFrame, distance: int, store: Scratch) -> DataFrame:
    """Edges (a, b) that connect all ``fp`` values of ``prints`` (distinct)
    within ``distance`` bits of each other; every edge is itself a link."""
    spark = prints.sparkSession
    ball = masks(-(-distance // 2))
    near = len(masks(distance // 2))
    n = prints.count()
    total, bits = n * len(ball), 0
    while total >> bits > max(ROUND_VARIANTS, ROUND_SHARE * n):
        bits += 1
    tasks = partitions(spark, total >> bits, TASK_VARIANTS)
    width = min(31, max(8, (4 * tasks - 1).bit_length()))
    some = max(1, SLICE_VARIANTS // max(1, len(ball) >> bits))
    dealt = prints.select("fp").repartition(tasks, "fp")

    def emit(turn):
        def run(batches):
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for i in range(0, len(fps), some):
                    rows = list(_emit(fps[i:i + some], ball, bits, turn, 64 - width))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                                          pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "f", "m"])
        return run

    def meet(batches):
        f, m = [], []
        for batch in batches:
            f.extend(batch.column(1).to_pylist())
            m.extend(batch.column(2).to_pylist())
        if not f:
            return
        edges = _meet(np.frombuffer(b"".join(f), np.uint64), np.frombuffer(b"".join(m), np.uint16), ball, near, distance).view(np.int64)
        for i in range(0, len(edges), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(edges[i:i + 100_000, 0]), pa.array(edges[i:i + 100_000, 1])], names=["a", "b"])

    found = None
    for turn in range(1 << bits):
        packed = dealt.mapInArrow(emit(turn), "bucket int, f binary, m binary")
        edges = store.write(packed.repartition(tasks, "bucket").mapInArrow(meet, "a long, b long"), f"edges{turn}")
        found = edges if found is None else found.unionByName(edges)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, key, fp, root, component_id) per row of ``docs``: root names
    the component by a fingerprint, component_id by the smallest id
    reachable over links, the row's own included."""
    store = Scratch(docs.sparkSession, "simhash")
    rows = store.write(fingerprints(docs, shingle), "prints")
    distinct = store.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = store.write(components(ball_edges(distinct, distance, store), store), "roots")
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = store.write(placed.join(lowest, "root").select(F.col("fp").alias("__fp"), "root", "component_id"), "ids")
    return rows.join(ids, rows.fp == ids["__fp"]).select("doc_id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One document of each component, with all its columns: that with the
    smallest id (of rows that share it, that with the smallest row key; of
    exactly repeated rows, one)."""
    rows = near_duplicates(docs, shingle, distance)
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = rows.where(own).groupBy("root").agg(F.min("component_id").alias("__id"), F.min("key").alias("__key"))
    best = Scratch(docs.sparkSession, "simhash").write(best.select("__id", "__key"), "kept")
    repeated = rows.groupBy("doc_id", "key").count().where("count > 1").limit(1).count() > 0
    hit = docs.join(best, F.col("doc_id").eqNullSafe(F.col("__id")) & (row_key() == F.col("__key")), "left_semi")
    return hit.withColumn("__key", row_key()).dropDuplicates(["doc_id", "__key"]).drop("__key") if repeated else hit
