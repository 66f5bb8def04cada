"""Scratch tables in the shared folder, row keys, connected components and
word arrays shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecast.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables in a fresh folder under ``spark.checkpoint.dir``.

    A written table survives lost executors and cuts the lineage.  The
    shuffle files of a write are released as soon as it ends, so the disk
    holds one step's shuffle at a time.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with released_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables of this scratch folder that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession):
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, old)


def partitions(spark: SparkSession, rows: int, target: int) -> int:
    """Pieces of about ``target`` rows, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // target))


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Second half of a row's identity beside its id, so that rows that
    share an id (or have none) but differ in text stay apart."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def components(edges: DataFrame, store: Scratch, label: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node reachable.  Alternating large-star and small-star rounds; each
    round is a written table, so nothing is collected and lineage stays
    short.  The star centre of a hub is found by a partial aggregate and
    hub joins are split by AQE.
    """
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where("u != v").distinct())
    e = store.write(e, f"{label}0")
    mark = None
    rounds = 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        rounds += 1
        e = store.write(small, f"{label}{rounds}")
        store.drop(f"{label}{rounds - 1}")
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --- words ----------------------------------------------------------------

MEMO_MAX = 200_000  # entries of a worker's memory of word hashes; a full one starts anew

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= MEMO_MAX:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_MEMO = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(_MEMO.__getitem__, words), dtype=np.uint64, count=len(words))


def forget_words() -> None:
    """Empty the worker's memory of word hashes, which a task fills again in
    a moment, so that it does not stand beside other steps' memories."""
    _MEMO.clear()


_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (polynomial, then mixed)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _BASE
        out += h[i:i + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column) -> list[bytes]:
    """A batch's texts as UTF-8; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def byte_runs(column, most: int = 2_000_000):
    """(first row, end row, texts as UTF-8) of a batch's column in runs of at
    most ``most`` bytes (a longer text stands alone); only one run is held."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for i, n in enumerate([*size, most + 1]):
        if i > start and held + n > most:
            yield start, i, text_bytes(column.slice(start, i - start))
            start, held = i, 0
        held += n


def slices(batch, texts: list[bytes], most: int = 8_000_000):
    """Row ranges of a batch that hold at most ``most`` bytes of text each
    (a longer text stands alone)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if len(texts) > start:
        yield start, len(texts)
