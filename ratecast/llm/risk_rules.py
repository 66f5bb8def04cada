"""Quality rules with risk-controlled thresholds.

Features of every whole text feed a logistic score that is fitted on a
bounded sample of the labelled documents.  Copies are no independent draws,
so labelled documents of one text (but for case, blanks and punctuation) lie
on one side of the split together, and each side takes one document of them
(copies with changed words still count as two).  One half is fitted on, the other half is
the holdout: in each stratum (language) the score cutoff
rises along a fixed grid for as long as the exact (Clopper-Pearson) upper
bound on the share of good documents falling below it stays within
``max_false_rejection``.  The level ``delta`` is divided by the number of
strata (Bonferroni); within a stratum the cutoffs are tested in a fixed
order and testing stops at the first failure, so no further correction is
due.  A stratum without enough labels keeps cutoff 0 and rejects nothing.

Defined cases: a null text is empty (no words, so the base rules fail it);
a null stratum is a stratum of its own; rows that repeat get equal
verdicts; of several labels of one document the most favourable counts;
labels other than 0 and 1 and labels of unknown documents are ignored;
with no labels at all only the base rules decide; empty tables give empty
results; columns beyond those named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch, byte_runs, forget_words, gram_hashes, row_key, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BINS = 1000          # steps of the cutoff grid
TRAIN_ROWS = 20_000  # bound of the labelled sample that the score is fitted on
FEATURES = ("f_words", "f_length", "f_symbols", "f_dup", "f_repeat", "f_upper", "f_punct")


def _repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Per text: words inside windows that occur twice or more in it."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros(len(words), dtype=np.int64)
    if not counts.sum():
        return out
    h = word_hashes([x for w in words for x in w])
    doc = np.repeat(np.arange(len(words)), counts)
    g = gram_hashes(h, WINDOW)
    n = len(g)
    if n == 0:
        return out
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    order = at[np.lexsort((g[at], doc[at]))]
    same = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    hit = np.zeros(len(order), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, order[hit], 1)
    np.add.at(edge, order[hit] + WINDOW, -1)
    np.add.at(out, doc[np.cumsum(edge[:-1]) > 0], 1)
    return out


def _line_repeats(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


_SPACE = b" \t\n\r\x0b\x0c"
_CONT = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_PUNCT = b".,;:!?\"'()[]{}=@+/\\~^_`-"


def _features(batches):
    for batch in batches:
        for a, b, part in byte_runs(batch.column(3)):
            words = [t.split() for t in part]
            n = np.array([len(w) for w in words], dtype=np.int64)
            chars = np.array([len(t.translate(None, _SPACE + _CONT)) for t in part], dtype=np.int64)
            sym = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in part], dtype=np.int64)
            dup = np.array([_line_repeats(t) for t in part], dtype=np.int64)
            rep = _repeat_words(words)
            lines = np.array([t.count(b"\n") + 1 for t in part], dtype=np.int64)
            upper = np.array([len(t) - len(t.translate(None, _UPPER)) for t in part], dtype=np.int64)
            punct = np.array([len(t) - len(t.translate(None, _PUNCT)) for t in part], dtype=np.int64)
            d, c = np.maximum(n, 1), np.maximum(chars, 1)
            cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a),
                    *map(pa.array, (n, chars, sym, dup, rep)),
                    *map(pa.array, (np.log1p(n) / 5, chars / d / 5, np.minimum(sym / d, 3), dup / lines, rep / d,
                                    np.minimum(10 * upper / c, 5), np.minimum(10 * punct / c, 5)))]
            yield pa.RecordBatch.from_arrays(cols, names=_NAMES)
    forget_words()


_NAMES = ["doc_id", "key", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES]


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: id, row key, stratum, the counts and the score's inputs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("key"), F.col(stratum).cast("string").alias("stratum"), "text").mapInArrow(
        _features, f"doc_id {kind}, key long, stratum string, n_words long, word_chars long, n_symbols long, "
        f"n_dup_lines long, n_repeat_words long, {', '.join(f + ' double' for f in FEATURES)}")


def fit_score(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic weights (constant first) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def binomial_upper(bad: int, n: int, delta: float) -> float:
    """Exact upper bound at level 1 - delta on a rate after ``bad`` of ``n``."""
    if n <= 0 or bad >= n:
        return 1.0
    lg = math.lgamma
    k = np.arange(bad + 1)
    choose = np.array([lg(n + 1) - lg(i + 1) - lg(n - i + 1) for i in k])

    def cdf(p):
        return float(np.exp(choose + k * math.log(p) + (n - k) * math.log1p(-p)).sum())

    lo, hi = bad / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid >= 1 or cdf(mid) <= delta:
            hi = mid
        else:
            lo = mid
    return hi


def choose_cutoff(bins: np.ndarray, good: np.ndarray, max_rate: float, delta: float) -> int:
    """Largest cutoff of the grid reached before the first failed test;
    documents in bins below it are rejected.  ``good[i]`` good holdout
    documents have their score in ``bins[i]``."""
    n = int(good.sum())
    below = np.concatenate([[0], np.cumsum(np.bincount(bins, weights=good, minlength=BINS + 1))])
    last = 0
    for cut in range(1, BINS + 1):
        if below[cut] != below[cut - 1] or cut == 1:
            if binomial_upper(int(below[cut]), n, delta) > max_rate:
                break
        last = cut
    return last


def grouped(docs: DataFrame, known: DataFrame, truth: DataFrame) -> DataFrame:
    """The labelled rows with ``unit``, their text but for case, blanks and
    punctuation (hashed), and ``half``, its side of the split."""
    unit = F.xxhash64(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", " ")))
    # hashed before the join, so that no text is shuffled
    units = docs.select(F.col("doc_id").alias("__id"), row_key().alias("__key"), unit.alias("unit"))
    units = units.join(truth.select(F.col("doc_id").alias("__id")), "__id", "left_semi").distinct()
    rows = known.join(units, (known.doc_id == F.col("__id")) & (known.key == F.col("__key"))).drop("__id", "__key")
    return rows.withColumn("half", F.pmod(F.xxhash64("unit", F.lit(7)), F.lit(2)))


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row per unit and stratum, drawn by hash (limited before the shuffle, so a large unit never meets whole)."""
    w = W.partitionBy("unit", "stratum").orderBy(F.xxhash64("doc_id", "key", F.lit(5)), "doc_id", "key")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = 0.01,
                  delta: float = 0.05, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``score_bin``,
    ``cutoff`` of its stratum and ``kept``."""
    spark = docs.sparkSession
    store = Scratch(spark, "quality")
    table = store.write(features(docs, stratum), "features")
    truth = (labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("good"))
             .where("doc_id is not null"))
    known = store.write(grouped(docs, table.join(truth, "doc_id"), truth), "known")
    draw = F.xxhash64("doc_id", F.lit(11))
    first = one_of_each(known.where("half = 0"))
    n = first.count()
    if n > 2 * train_rows:  # thinned before it is ordered, so that few rows beyond the bound reach the driver
        first = first.where(F.pmod(draw, F.lit(1 << 31)) < int((1 << 31) * 2 * train_rows / n))
    sample = (first.orderBy(draw, "key").limit(train_rows)
              .select(*FEATURES, "good").toPandas())
    w = fit_score(sample[list(FEATURES)].to_numpy(float), sample["good"].to_numpy(float))
    logit = F.lit(float(w[0]))
    for f, v in zip(FEATURES, w[1:]):
        logit = logit + F.col(f) * F.lit(float(v))
    bin_ = F.least(F.greatest(F.floor((logit + 10) * (BINS / 20)), F.lit(0)), F.lit(BINS)).cast("int")

    strata = table.select("stratum").distinct().count()
    hold = (one_of_each(known.where("half = 1 and good = 1")).groupBy("stratum", bin_.alias("bin")).agg(F.count("*").alias("n")))
    level = delta / max(strata, 1)

    def cut(pdf):
        c = choose_cutoff(pdf["bin"].to_numpy(), pdf["n"].to_numpy(float), max_false_rejection, level)
        return pdf.head(1)[["stratum"]].assign(cutoff=np.int32(c), holdout=np.int64(pdf["n"].sum()))

    cuts = hold.groupBy("stratum").applyInPandas(cut, "stratum string, cutoff int, holdout long")
    cuts = cuts.select(F.col("stratum").alias("s"), "cutoff", "holdout")
    out = (table.withColumn("score_bin", bin_).join(cuts, F.col("stratum").eqNullSafe(F.col("s")), "left").drop("s")
           .withColumn("cutoff", F.coalesce("cutoff", F.lit(0))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (out.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score_bin") >= F.col("cutoff")))
            .select("doc_id", "key", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "score_bin", "cutoff", F.coalesce("holdout", F.lit(0)).alias("holdout"), "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    kept = (quality_rules(docs, labels, **settings).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (row_key() == F.col("__key")), "left_semi")
