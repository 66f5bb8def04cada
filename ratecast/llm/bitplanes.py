"""Token ids written as bit or byte planes.

Texts are encoded first, where they lie, and written as 16-bit ids; the ids
are then range-partitioned by document, so that no text is shuffled.  A
partition is a shard.  In a shard runs of whole documents make a chunk of
about ``CHUNK_IDS`` ids.  A chunk's ids are cut into blocks of ``block``
ids, each block is transposed into planes (all lowest bytes, then all
second bytes, ...; or bit by bit), and each plane of each block is
compressed with zstandard by itself.  The file set is a Parquet table of
chunks, which hold the planes one after another, and beside it the chunk
index: shard, chunk, first id's place in the shard, number of ids,
documents and bytes, a checksum, and the offset of each plane's end, by
which any block is read alone (``read_block``).  Parquet is only the
container, so that the files can lie in any store Spark reaches and a lost
executor leaves no half-written file.

Reading needs no shuffle: each chunk holds whole documents and its offsets,
and a shard's place among all ids is a prefix sum over the shards' totals.

Defined cases: a null or empty text has the end id alone; rows without an
id come first; rows that share an id are ordered by a hash of their text; an empty table
gives an empty file set and result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch, partitions
from ratecast.llm.tokens import batches_of_texts, encoder
from ratecast.session import bounded_broadcast

END = 2
VOCABULARY = "byte_bpe_50k.json"
BLOCK = 16_384
CHUNK_IDS = 1 << 19
SHARD_ROWS = 20_000
LEVEL = 3


def shuffle_planes(ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = LEVEL) -> list[bytes]:
    """Compressed planes of unsigned ids: block by block, in a block the lowest
    first.  Planes above the highest that any block uses are left out."""
    width = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    packer, out = zstandard.ZstdCompressor(level=level), []
    for a in range(0, len(raw), block):
        rows = raw[a:a + block].T if not bits else np.packbits(np.unpackbits(raw[a:a + block], axis=1, bitorder="little").T, axis=1, bitorder="little")
        out += [packer.compress(row.tobytes()) for row in rows]
    return out


def _restore(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ``n`` ids of one block."""
    opener = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(opener.decompress(p), np.uint8) for p in planes]
    if bits:
        cells = np.stack([np.unpackbits(r, bitorder="little")[:n] for r in rows], axis=1)
        rows = np.packbits(cells, axis=1, bitorder="little").T
    out = np.zeros((n, 4), np.uint8)
    for j, r in enumerate(rows):
        out[:, j] = r
    return out.view("<u4").ravel()


def restore_planes(planes: list[bytes], n: int, block: int = BLOCK, bits: bool = False) -> np.ndarray:
    """The ids that ``shuffle_planes`` was given."""
    starts = range(0, n, block)
    each = len(planes) // len(starts) if n else 0
    return np.concatenate([np.empty(0, "<u4"), *(_restore(planes[i * each:(i + 1) * each], min(block, n - a), bits) for i, a in enumerate(starts))])


_CHUNK = "shard int, chunk int, first long, n_ids long, n_docs long, crc long, block int, bits boolean, ends array<long>, lengths binary, docs array<{kind}>, planes binary"
_INDEX = ["shard", "chunk", "first", "n_ids", "n_docs", "crc", "block", "bits", "ends"]


def _cut(planes: bytes, ends: list[int]) -> list[bytes]:
    return [planes[a:b] for a, b in zip([0, *ends], ends)]


def write_ids(docs: DataFrame, store: Scratch, name: str = "ids", vocabulary: str = VOCABULARY, end_id: int = END,
              block: int = BLOCK, bits: bool = False, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode, order by id and write the file set ``name`` and its index."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = docs.schema["doc_id"].dataType

    def encode(batches):
        enc = encoder(vocabulary)
        tail = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for at, texts in batches_of_texts(batch, 2):
                ids = [raw + tail for raw in enc.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), batch.column(1).slice(at, len(ids)), pa.array([enc.dtype.itemsize] * len(ids), pa.int32()),
                     pa.array(ids, pa.binary())], names=["doc_id", "tie", "width", "ids"])

    # a hash of the text parts rows that share an id
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    encoded = store.write(rows.mapInArrow(encode, f"doc_id {kind}, tie long, width int, ids binary"), f"{name}_encoded")
    n = partitions(spark, encoded.count(), SHARD_ROWS)
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ordered = encoded.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        ids, names, held, width = [], [], 0, 2

        def close():
            nonlocal chunk, first, ids, names, held
            all_ids = np.frombuffer(b"".join(ids), dtype=f"<u{width}")
            lengths = np.array([len(x) // width for x in ids], dtype="<i8")
            planes = shuffle_planes(all_ids, block, bits)
            body = b"".join(planes)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()), pa.array([len(all_ids)], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([zlib.crc32(body)], pa.int64()), pa.array([block], pa.int32()), pa.array([bits]),
                 pa.array([np.cumsum([len(p) for p in planes]).tolist()], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()),
                 pa.array([names], pa.list_(to_arrow_type(arrow))), pa.array([body], pa.binary())],
                names=[*_INDEX, "lengths", "docs", "planes"])
            chunk, first, ids, names, held = chunk + 1, first + len(all_ids), [], [], 0
            return out

        for batch in batches:
            for i, doc in enumerate(batch.column(0).to_pylist()):
                width = batch.column(1)[i].as_py()
                ids.append(batch.column(2)[i].as_py())
                names.append(doc)
                held += len(ids[-1]) // width
                if held >= chunk_ids:
                    yield close()
        if ids:
            yield close()

    files = store.write(ordered.select("doc_id", "width", "ids").mapInArrow(run, _CHUNK.format(kind=kind)), name)
    store.drop(f"{name}_encoded")
    store.write(files.select(*_INDEX, F.octet_length("planes").cast("long").alias("n_bytes")), f"{name}_index")


def read_block(spark: SparkSession, store: Scratch, shard: int, chunk: int, number: int, kind: str = "bigint", name: str = "ids") -> np.ndarray:
    """The ids of one block of a chunk, from its planes alone."""
    here = (F.col("shard") == shard) & (F.col("chunk") == chunk)
    index = store.read(f"{name}_index", "shard int, chunk int, n_ids long, block int, bits boolean, ends array<long>").where(here).first()
    blocks = -(-index["n_ids"] // index["block"])
    each = len(index["ends"]) // blocks
    ends = [0, *index["ends"]][number * each:(number + 1) * each + 1]
    part = store.read(name, _CHUNK.format(kind=kind)).where(here).select(F.substring("planes", ends[0] + 1, ends[-1] - ends[0]).alias("p")).first()["p"]
    return _restore(_cut(bytes(part), [e - ends[0] for e in ends[1:]]), min(index["block"], index["n_ids"] - number * index["block"]), index["bits"])


def read_ids(spark: SparkSession, store: Scratch, kind: str = "bigint", name: str = "ids", digest: bool = False) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids) with ids
    little-endian 32-bit, or their checksum ``ids_crc32`` for ``digest``."""
    files = store.read(name, _CHUNK.format(kind=kind))
    index = store.read(f"{name}_index", "shard int, n_ids long")
    # one row per shard
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # twelve bytes a shard: broadcast where a count proves them few, so that the files are not shuffled
    begins = bounded_broadcast(shards.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names) if c != "docs"}
                if zlib.crc32(row["planes"]) != row["crc"]:
                    raise ValueError(f"shard {row['shard']} chunk {row['chunk']}: checksum differs")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ids = restore_planes(_cut(row["planes"], row["ends"]), row["n_ids"], row["block"], row["bits"])
                ends = np.cumsum(lengths)
                cut = [ids[b - n:b].tobytes() for b, n in zip(ends.tolist(), lengths.tolist())]
                docs = batch.column(batch.schema.get_field_index("docs"))
                last = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(i, 1).flatten(), pa.array(row["begin"] + row["first"] + ends - lengths), pa.array(lengths.astype(np.int64)), last],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    joined = files.join(begins, "shard").select("shard", "chunk", "first", "n_ids", "crc", "block", "bits", "ends", "lengths", "docs", "planes", "begin")
    return joined.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_files(docs: DataFrame, digest: bool = False, **settings) -> DataFrame:
    """Write all documents' ids and read them back."""
    store = Scratch(docs.sparkSession, "token-ids")
    write_ids(docs, store, **settings)
    return read_ids(docs.sparkSession, store, docs.schema["doc_id"].dataType.simpleString(), digest=digest)
