"""Substring dedup by seed and extend.

Words are hashed and winnowed: of the ``k``-word grams that start in a
window of ``span`` words, the smallest hash is the window's anchor, so equal
windows choose the same anchor wherever they stand.  Documents are joined on
the anchors, and around each anchor the match is extended to both sides as
far as the windows that chose it are equal.  A window that also starts in a
document with a smaller id is a repeat; overlapping repeats are merged into
maximal ones, at least ``span`` words long, and their words are removed.

A chunk of documents settles its own repeats first: of equal windows in a
chunk only those of its smallest id travel on, so an anchor that a third of
all documents share costs a row per chunk, not one per document.  What
travels is packed by anchor bucket: runs of neighbouring windows with one
anchor and the windows' hashes.  An anchor that many different windows share
would fill one task, so anchors that a sample shows as frequent are dealt by
the windows' hashes instead (the sample decides only where windows meet:
equal ones have one anchor and one hash).  Equality is that of 64-bit hashes of the 13
words.

Defined cases: a null text has no words; rows without an id neither remove
nor lose words; rows that share an id do not remove each other's words;
repeated rows get equal results; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch, gram_hashes, partitions, row_key, slices, text_bytes, word_hashes

SPAN = 13
GRAM = 5
CHUNK_BYTES = 4_000_000
TASK_BYTES = 8_000_000  # of text per reducing task
SAMPLE = 1 / 256   # of the documents, to find frequent anchors
SAMPLE_ROWS = 4_000  # documents in it at least


def _windows(texts: list[bytes], span: int, k: int):
    """(text number, start, anchor position, anchor hash, window hash) of each window."""
    words = [t.split() for t in texts]
    count = np.array([len(w) for w in words], dtype=np.int64)
    h = word_hashes([x for w in words for x in w])
    n = len(h) - span + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    g = gram_hashes(h, k)
    low, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span - k + 1):
        less = g[j:j + n] < low
        low[less] = g[j:j + n][less]
        at[less] = j
    good = np.flatnonzero(owner[:n] == owner[span - 1:])
    return owner[good], place[good], place[good] + at[good], low[good], gram_hashes(h, span)[good]


def _ranges(doc, key, start, span):
    """Merge window starts into (doc, key, first word, end) ranges."""
    if not len(doc):
        return doc, key, start, start
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + span)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], key[first], start[first], start[last] + span


def _later(doc: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Where a window also stands in a document with a smaller id."""
    order = np.lexsort((doc, window))
    d, w = doc[order], window[order]
    head = np.concatenate([[True], w[1:] != w[:-1]])[:len(w)]
    first = d[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(w) else d
    out = np.empty(len(w), bool)
    out[order] = d > first
    return out


def frequent_anchors(rows: DataFrame, store: Scratch, count: int, tasks: int, span: int = SPAN, k: int = GRAM) -> np.ndarray:
    """Anchors with more than an eighth of a task's windows, by a sample of the documents."""
    share = max(SAMPLE, SAMPLE_ROWS / max(count, 1))
    sample = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in slices(batch, texts, CHUNK_BYTES):
                anchor, n = np.unique(_windows(texts[a:b], span, k)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    per = store.write(sample.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = per.agg(F.sum("n")).first()[0] or 0
    often = per.where(F.col("n") > max(16, total / (8 * tasks))).select("anchor").collect()
    return np.array(sorted(r[0] for r in often), np.int64).view(np.uint64)


def packed(rows: DataFrame, hot: np.ndarray, width: int, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """Runs of windows by bucket (2 ** ``width`` of them), and settled ranges."""
    def seeds(batches):
        turn = 0
        for batch in batches:
            texts = text_bytes(batch.column(2))
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in slices(batch, texts, CHUNK_BYTES):
                owner, start, anchor, seed, window = _windows(texts[a:b], span, k)
                doc, key = ids[a:b][owner], keys[a:b][owner]
                gone = _later(doc, window)
                out = [[], [], [], [], [], [], []]

                def put(bucket, *arrays):
                    for column, x in zip(out, (bucket, *arrays)):
                        column.append(x if isinstance(x, int) else x.tobytes())

                if gone.any():
                    turn += 1
                    d, y, s, e = _ranges(doc[gone], key[gone], start[gone], span)
                    put((turn * 7919) % (1 << width), d, y, s.astype(np.int32), np.empty(0, np.uint8), np.empty(0, np.uint64), e.astype(np.int32))
                left = np.flatnonzero(~gone)
                owner, start, anchor, seed, window, doc, key = (x[left] for x in (owner, start, anchor, seed, window, doc, key))
                if len(left):
                    head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
                    often = np.isin(seed, hot)
                    head |= often
                    first = np.flatnonzero(head)
                    size = np.diff(np.append(first, len(left)))
                    dealt = np.where(often, window, seed)
                    bucket = ((dealt[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    bucket, first, size = bucket[order], first[order], size[order]
                    ends = np.cumsum(size)
                    flat = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
                    window = window[flat]
                    cut = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
                    none = np.empty(0, np.int32)
                    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                        f = first[x:y]
                        put(int(bucket[x]), doc[f], key[f], start[f].astype(np.int32), size[x:y].astype(np.uint8),
                            window[ends[x] - size[x]:ends[y - 1]], none)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
                                                     names=["bucket", "doc", "key", "start", "size", "window", "stop"])

    return rows.mapInArrow(seeds, "bucket int, doc binary, key binary, start binary, size binary, window binary, stop binary")


def repeats(docs: DataFrame, store: Scratch, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(doc_id, key, start, stop): maximal word ranges to remove."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    tasks = partitions(spark, size or 0, TASK_BYTES)
    width = max(9, min(20, (4 * tasks - 1).bit_length()))
    hot = frequent_anchors(rows, store, count, tasks, span, k)

    def extend(batches):
        settled, open_ = [], [[], [], [], [], []]
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(1, 7)]
            for d, y, s, n, w, e in zip(*cols):
                if e:
                    settled.append(tuple(np.frombuffer(x, t) for x, t in ((d, np.int64), (y, np.int64), (s, np.int32), (e, np.int32))))
                else:
                    for column, x in zip(open_, (d, y, s, n, w)):
                        column.append(x)
        if open_[0]:
            doc, key, start, size, window = (np.frombuffer(b"".join(x), t) for x, t in zip(
                open_, (np.int64, np.int64, np.int32, np.uint8, np.uint64)))
            del open_
            size = size.astype(np.int64)
            within = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
            run = np.repeat(np.arange(len(size)), size)
            gone = np.flatnonzero(_later(doc[run], window))
            run = run[gone]
            settled.append(_ranges(doc[run], key[run], start[run] + within[gone], span))
        for d, y, s, e in settled:
            for i in range(0, len(d), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 100_000].astype(np.int64)) for x in (d, y, s, e)],
                                                 names=["doc_id", "key", "start", "stop"])

    found = packed(rows, hot, width, span, k).repartition(tasks, "bucket")
    return store.write(found.mapInArrow(extend, "doc_id long, key long, start long, stop long"), "repeats")


def remove_repeats(docs: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one blank."""
    store = Scratch(docs.sparkSession, "substrings")
    found = repeats(docs, store, span, k)
    per_doc = found.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.collect_list(F.struct("start", "stop")).alias("cut"))
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    joined = rows.join(per_doc, (F.col("doc_id") == F.col("__id")) & (F.col("key") == F.col("__key")), "left").select("doc_id", "text", "cut")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            n, gone, kept = [], [], []
            for t, cut in zip(texts, batch.column(2).to_pylist()):
                words = t.split()
                n.append(len(words))
                if cut:
                    keep, at = [], 0
                    for c in sorted((c["start"], c["stop"]) for c in cut):
                        if c[0] > at:
                            keep += words[at:c[0]]
                        at = max(at, c[1])
                    words = keep + words[at:]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SPAN - 1} + 1, 1)::BIGINT)) AS i FROM w),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + {SPAN - 1}], ' ') AS s FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SPAN})) AS pos FROM m WHERE doc_id > first),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT t.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY pos) AS s FROM t ANTI JOIN gone USING (doc_id, pos) GROUP BY t.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""
