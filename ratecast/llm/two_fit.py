"""Best-two-fit packing of token sequences.

Texts become ids with an end id; those longer than the capacity are cut
into pieces of exactly the capacity, the first one shorter.  Pieces of one
length are interchangeable, so the packing works on the count per length,
a table of at most ``capacity`` rows whatever the corpus: a bin is filled
greedily with the longest piece that fits, again and again; then its
smallest piece is taken out if two unpacked pieces fill the gap so widened
more tightly.  The same bin is repeated while the counts of its lengths
last, which makes a pattern with a number of bins.  Spark then places the
pieces: the n-th piece of a length takes the n-th slot of that length.
Ranks of a length are kept per input partition while encoding and offset
by sums over partitions, so no length, however hot, is sorted in one task.
Only a piece's length and rank go to the function that places it; its ids
are written once, while encoding.

Defined cases: a null or empty text is one piece with the end id alone;
repeated rows are packed each; ties between pairs go to the pair with the
longest piece; an empty table gives an empty result.  Only ``doc_id`` and
``text`` are read; columns that callers add to the pieces stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch
from ratecast.llm.tokens import batches_of_texts, encoder

CAPACITY = 2048
END = 0
BROADCAST_ROWS = 200_000  # counts per part and length (three numbers each, some 10 MB) up to which they are broadcast
VOCABULARY = "byte_bpe_50k.json"


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, length, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END, vocabulary: str = VOCABULARY, remembered: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth) per piece: ids are
    little-endian 32-bit, nth counts the pieces of its length in ``part``."""

    def run(batches):
        enc = encoder(vocabulary, remembered)
        tail = np.array([end_id], dtype=enc.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for first, texts in batches_of_texts(batch, 1):
                at, rows = [], []
                for i, raw in enumerate(enc.encode(texts)):
                    ids = np.frombuffer(raw + tail, dtype=enc.dtype).astype("<u4")
                    for n, (a, size) in enumerate(cuts(len(ids), capacity)):
                        at.append(first + i)
                        rows.append((n, a, size, ids[a:a + size].tobytes(), int(seen[size])))
                        seen[size] += 1
                n, a, size, ids, nth = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary, part int, nth long")


def _fill(have: np.ndarray, gap: int) -> list[int]:
    """Greedy: the longest piece left that fits, until none does."""
    have, out = have.copy(), []
    while gap > 0:
        fits = np.flatnonzero(have[:gap + 1])
        if not len(fits):
            break
        size = int(fits[-1])
        take = min(int(have[size]), gap // size)
        out += [size] * take
        have[size] -= take
        gap -= take * size
    return out


def _two(have: np.ndarray, least: int, gap: int) -> tuple[int, int] | None:
    """The two lengths left with the largest sum above ``least`` that fits ``gap``."""
    sizes = np.flatnonzero(have[:gap + 1])
    if not len(sizes):
        return None
    # for each longer length, the largest other one that fits beside it
    at = np.searchsorted(sizes, np.minimum(gap - sizes, sizes), side="right") - 1
    twice = (at >= 0) & (sizes[np.maximum(at, 0)] == sizes) & (have[sizes] < 2)
    at = np.where(twice, at - 1, at)
    total = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], -1)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(sizes[best]), int(sizes[at[best]])) if total[best] > least else None


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), by best-two-fit on the counts."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        have[size] = n
    out = []
    while have.any():
        bin_ = _fill(have, capacity)
        left = have.copy()
        np.subtract.at(left, bin_, 1)
        if len(bin_) > 1:
            least = bin_[-1]
            pair = _two(left, least, capacity - sum(bin_) + least)
            if pair:
                bin_ = bin_[:-1] + list(pair)
        need = np.bincount(bin_, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((have[used] // need[used]).min())
        have[used] -= times * need[used]
        out.append((bin_, times))
    return out


def slots(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset in the bin, pattern's
    bins): the ranks [first, end) of a length lie at one offset of successive bins."""
    out, ranks, sequence = [], {}, 0
    for bin_, times in found:
        offset = 0
        for size in bin_:
            rank = ranks.get(size, 0)
            out.append((size, rank, rank + times, sequence, offset))
            ranks[size] = rank + times
            offset += size
        sequence += times
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces;
    ``part`` and ``nth`` go, all other columns stay."""
    spark = cut.sparkSession
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most ``capacity`` lengths reach the driver
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(patterns(counts, capacity))
    before = per_part.select(F.col("length").alias("__l"), F.col("part").alias("__p"), F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    if per_part.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        before = F.broadcast(before)  # else a shuffle join
    by_length: dict[int, list] = {}
    for size, a, b, s, o in table:
        by_length.setdefault(size, []).append((a, b, s, o))

    ready = {size: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for size, rows in by_length.items()}
    shared = spark.sparkContext.broadcast(ready)  # at most a slot per pattern and place: bounded by the lengths

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        by, length, rank = shared.value, length.to_numpy(), rank.to_numpy()
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length):
            here = np.flatnonzero(length == size)
            first, _, sequence, offset = by[int(size)]
            i = np.searchsorted(first, rank[here], side="right") - 1
            seq[here] = sequence[i] + rank[here] - first[i]
            off[here] = offset[i]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    names = [c for c in cut.columns if c not in ("part", "nth")]
    ranked = cut.join(before, (F.col("length") == F.col("__l")) & (F.col("part") == F.col("__p")))
    found = ranked.select(*names, placed("length", F.col("nth") + F.col("__before")).alias("__at"))
    return found.select(*names, "__at.sequence_id", "__at.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END, vocabulary: str = VOCABULARY, with_ids: bool = True,
         remembered: int | None = None) -> DataFrame:
    """Pieces with their place: (doc_id, piece, start, length, ids or
    ids_crc32, sequence_id, offset).  The ids of a sequence are those of its
    pieces by offset, without gaps.  A worker remembers ``remembered`` units of text."""
    store = Scratch(docs.sparkSession, "pack")
    cut = pieces(docs, capacity, end_id, vocabulary, remembered)
    if not with_ids:
        cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(store.write(cut, "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): each bin's ids in one row, at most the capacity."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"))
