"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words; a source whose target exceeds
its size gives every document once per complete epoch, and the rest of the
target is filled by sampling without replacement: a document's key is an
exponential draw divided by its quality weight, documents are taken in
ascending order of their keys, and a prefix sum of their sizes stops at the
budget.  The document in which the budget ends is taken in part (its first
words), so a source's words meet its target to the rounding.

Only DataFrame operations run here.  The prefix sum has two levels: a key's
expected rank in its source, known from the source's counts per quality
class, cuts the source into pieces of about ``PIECE_ROWS`` rows; pieces are
summed first, and a row's window covers its own piece, so a hot source is
spread over many tasks.  Windows over whole sources see one row per piece
or per source.

The draw is a hash of the id, the same in every run.  Defined cases: a null
text has size 0 and is taken 0 words; a null source is a source of its own,
last in order; rows without an id draw from their text; repeated rows tie
and share out the budget in any order, which gives the same rows; an empty
table gives an empty result.  Columns beyond ``doc_id``, ``text`` and
``source`` are not read by ``mix``, and ``mixed_documents`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch, row_key

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MAX_EPOCHS = 3
PIECE_ROWS = 4_000
CLASSES = 8       # of quality; class c weighs 1 / (1 + c / 2)


def word_count(text: Column) -> Column:
    """Number of runs of other characters than blank, tab, line ends and the like."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_class(text: Column, size: Column) -> Column:
    """0 for plain prose, up to ``CLASSES`` - 1 the more symbols a word there is."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return F.coalesce(F.when(size > 0, F.least(F.lit(CLASSES - 1), F.floor(CLASSES * symbols / size))), F.lit(0)).cast("int")


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, key, source, size, class, draw) per row.  With u uniform, the
    sampling key -ln(u) / weight ascends as draw = u ** (1 / weight) descends."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text")), F.lit(""))
    # 52 bits of a digest, so that any engine can repeat the draw
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident)), 1, 13), 16, 10).cast("double") + 0.5) / 2.0 ** 52
    rows = docs.select("doc_id", row_key().alias("key"), "source", word_count(F.col("text")).alias("size"), "text", u.alias("u"))
    rows = rows.select("doc_id", "key", "source", "size", quality_class(F.col("text"), F.col("size")).alias("class"), "u")
    return rows.select("doc_id", "key", "source", "size", "class", F.pow("u", 1 + F.col("class") / 2).alias("draw"))


def targets(per_source: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, rows, source_size).

    A source stops at its cap, ``max_epochs`` times its size, and what it
    leaves is shared again by weight: the targets are min(cap, weight * t)
    for the one level t at which they sum to all sizes.  Sources ordered by
    cap / weight reach their caps one after the other, so t follows from
    running sums.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    s = per_source.withColumn("n", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("n", F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "n")
    everything = W.partitionBy(F.lit(1))
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - capped) / open_weight)
    # the level rises while caps are reached and falls after that
    s = s.withColumn("t", F.max("level").over(everything))
    return s.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("t")))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken) per row."""
    store = Scratch(docs.sparkSession, "mix")
    rows = store.write(sizes(docs, seed), "sizes")
    of_class = [F.sum((F.col("class") == c).cast("long")).alias(f"c{c}") for c in range(CLASSES)]
    per_source = rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"), *of_class)
    plan = store.write(targets(per_source, weights, max_epochs).select(
        F.col("source").alias("s"), "rows", "source_size", "target", *(f"c{c}" for c in range(CLASSES))), "targets")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    # share of the source's draws expected above a row's: of class c, those with u ** (1 + c / 2) > draw
    rank = sum((F.col(f"c{c}") / F.col("rows") * (1 - F.pow("draw", F.lit(1 / (1 + c / 2)))) for c in range(CLASSES)), F.lit(0.0))
    # whole epochs, then what is left for the fractional selection
    rows = (rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
            .withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
            .withColumn("pieces", F.ceil(F.col("rows") / PIECE_ROWS))
            .withColumn("piece", F.floor(rank * F.col("pieces"))))
    sums = rows.groupBy("source", "piece").agg(F.sum("size").alias("in_piece"))
    before = sums.select(F.col("source").alias("ps"), F.col("piece").alias("pp"), F.coalesce(
        F.sum("in_piece").over(W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("ps")) & (F.col("piece") == F.col("pp")))
    inside = W.partitionBy("source", "piece").orderBy(F.desc("draw"), "doc_id", "key").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.least(left, F.col("size")), F.lit(0))
    return rows.withColumn("taken", taken.cast("long")).select("doc_id", "key", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, length_col: str | None = "n_chars", **settings) -> DataFrame:
    """The mix as documents: a row per whole epoch of a document and one with
    its first words for a fractional part; all columns stay."""
    store = Scratch(docs.sparkSession, "mix")
    taken = store.write(mix(docs, **settings).where("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("taken").alias("__taken")), "taken")
    own = docs.withColumn("__row", row_key())
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
    if taken.groupBy("__id", "__key").count().where("count > 1").limit(1).count():
        # rows repeated exactly: number them, so that each gets one share
        taken = taken.withColumn("__n", F.row_number().over(W.partitionBy("__id", "__key").orderBy(F.desc("__taken"))))
        own = own.withColumn("__m", F.row_number().over(W.partitionBy("doc_id", "__row").orderBy(F.lit(0))))
        match = match & (F.col("__m") == F.col("__n"))
    hit = own.join(taken, match)
    part = F.col("__taken") % F.col("__size")
    copies = F.array_repeat(F.col("__size"), F.floor(F.col("__taken") / F.col("__size")).cast("int"))
    hit = hit.withColumn("__words", F.explode(F.when(part > 0, F.concat(copies, F.array(part))).otherwise(copies)))
    # cut behind each word: a piece is a word and the white space before it
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    whole = F.col("__words") == F.col("__size")
    out = hit.withColumn("__text", F.when(whole, F.col("text")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.col("__words").cast("int")), "")))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(whole, F.col(length_col)).otherwise(F.length("__text")))
    return out.withColumn("text", F.col("__text")).select(*docs.columns)


def _sql() -> str:
    weights = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH r AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
d AS (SELECT doc_id, source, size, pow((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 't' || text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2.0, 52),
    1 + CASE WHEN size > 0 THEN least({CLASSES - 1}, floor({CLASSES} * len(regexp_extract_all(text, '[#*$%&|<>]')) / size)) ELSE 0 END / 2) AS draw FROM r),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} {weights} END AS weight,
    {MAX_EPOCHS} * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, round(target - epochs * source_size)::BIGINT - coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw DESC, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM e)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(least(rest, size), 0))::BIGINT AS taken FROM p"""


SQL = _sql()
