"""Sharding by extendible hashing.

The directory starts as one bucket; a bucket over the byte limit, and only
such a one, splits on the next bit of its documents' hash, until every
bucket fits.  A bucket's depth is therefore the smallest number of leading
bits at which its documents fit.  The bytes are summed once at a depth a
little beyond the expected one and rolled up to all shallower depths; what
is still too large there is taken further down in the same way, so each
round sees only the buckets that must still split.

A document larger than the limit gets a bucket of its own.  Rows equal in
id and text have equal hashes, which no bit can part; their bucket is
chained into pages of as many rows as fit.

Defined cases: a null text has 0 bytes; a null id hashes like an empty one;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch

MAX_BYTES = 16 << 20
BITS = 60


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_bytes): the hash has ``BITS`` bits."""
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.conv(F.substring(F.md5(ident), 1, BITS // 4), 16, 10).cast("long").alias("h"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def directory(rows: DataFrame, max_bytes: int, store: Scratch) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_docs) of every bucket."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    step = min(BITS, max(0, math.ceil(math.log2(max(total / max_bytes, 1)))) + 2)
    top, leaves, turn = 0, None, 0
    while True:
        deep = min(BITS, top + step)
        fine = rows.groupBy(F.shiftright("h", BITS - deep).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        fine = store.write(fine, f"fine{turn}")
        each = fine.withColumn("depth", F.explode(F.sequence(F.lit(top), F.lit(deep))))
        up = each.withColumn("prefix", F.expr(f"shiftright(fine, {deep} - depth)"))
        sums = up.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS))
        # a bucket is a leaf when it fits and the one that it was split from does not
        parent = fits.select((F.col("depth") + 1).alias("depth"), F.expr("prefix").alias("above"))
        own = fits.withColumn("above", F.shiftright("prefix", 1)).join(parent, ["depth", "above"], "left_anti")
        own = store.write(own.select("depth", "prefix", "shard_bytes", "shard_docs"), f"leaves{turn}")
        leaves = own if leaves is None else leaves.unionByName(own)
        rest = sums.where((F.col("depth") == deep) & (F.col("shard_bytes") > max_bytes) & (F.col("shard_docs") > 1)).select("prefix")
        if deep == BITS or not rest.limit(1).count():
            return leaves
        rest = store.write(rest, f"rest{turn}")
        rows = rows.join(rest, F.shiftright("h", BITS - deep) == rest.prefix, "left_semi")
        top, step, turn = deep + 1, 4, turn + 1


def shards(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page, shard_bytes, shard_docs): the
    shard of a document is (depth, prefix, page), prefix as a string of
    bits; bytes and documents are the shard's."""
    store = Scratch(docs.sparkSession, "shards")
    rows = store.write(hashed(docs).withColumn("part", F.spark_partition_id()), "rows")
    leaves = store.write(directory(rows, max_bytes, store), "leaves")
    # bits below the depth are filled up, so that a row's bucket is the last that begins at or before its hash
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most BITS + 1 numbers
    tagged = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")))
    tagged = tagged.withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)")).join(leaves, ["depth", "prefix"])
    fixed = tagged.where((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1)).withColumn("page", F.lit(0).cast("long"))
    # equal rows beyond the limit: numbered by part and in the part, dealt into pages
    over = tagged.where((F.col("shard_bytes") > max_bytes) & (F.col("shard_docs") > 1))
    per = over.groupBy("h", "part").agg(F.count("*").alias("n"))
    before = per.select(F.col("h").alias("__h"), F.col("part").alias("__p"), F.coalesce(
        F.sum("n").over(W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("h", "part").orderBy("doc_id")) - 1 + F.col("before")
    fit = F.greatest(F.floor(F.lit(max_bytes) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    over = (over.join(before, (F.col("h") == F.col("__h")) & (F.col("part") == F.col("__p")))
            .withColumn("page", F.floor(nth / fit).cast("long"))
            .withColumn("shard_docs", F.least(fit, F.col("shard_docs") - F.col("page") * fit))
            .withColumn("shard_bytes", F.col("shard_docs") * F.col("n_bytes")))
    cols = ["doc_id", "n_bytes", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.expr("lpad(bin(prefix), depth, '0')")).alias("prefix"), "page", "shard_bytes", "shard_docs"]
    return fixed.select(*cols).unionByName(over.select(*cols))


SQL = f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS h,
    coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
g AS (SELECT depth, h >> ({BITS} - depth) AS p, sum(n_bytes)::BIGINT AS b, count(*) AS n
    FROM r, (SELECT unnest(range(0, 25))::INTEGER AS depth) GROUP BY ALL),
f AS (SELECT r.doc_id, r.n_bytes, min_by(g, g.depth) AS leaf FROM r JOIN g ON g.p = r.h >> ({BITS} - g.depth)
    WHERE g.b <= {MAX_BYTES} OR g.n = 1 GROUP BY ALL)
SELECT doc_id, n_bytes, leaf.depth AS depth, CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(leaf.p), leaf.depth, '0') END AS prefix,
    0::BIGINT AS page, leaf.b AS shard_bytes, leaf.n::BIGINT AS shard_docs FROM f"""
