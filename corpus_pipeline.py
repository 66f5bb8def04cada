"""The training-data pipeline: quality rules, SimHash near-duplicates, PII,
mixing and packing, each stage over all that the one before it kept."""

from __future__ import annotations

from ratecast.llm import mixing, pii_crf, risk_rules, simhash_ball, two_fit
from ratecast.llm.common import Scratch
from ratecast.plans.tables import table


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return risk_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash component stays."""
    return simhash_ball.keep_one(docs)


def pii(spark, docs, sf_dir):
    """Personal data is replaced by its kind."""
    return pii_crf.mask(docs)


def mix(spark, docs, sf_dir):
    """Sources come near their target weights: documents repeat, go or are cut."""
    return mixing.mixed_documents(docs)


def pack(spark, docs, sf_dir):
    """Pieces of token ids with their place in the training sequences."""
    return two_fit.pack(docs, remembered=UNITS)


UNITS = 200_000  # remembered by a worker, which also holds what the other stages left in it

STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("PII", pii), ("mixing", mix), ("best-fit packing", pack)]

# trained models, a fingerprint function and a tokenizer that SQL lacks
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read again."""
    store = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = store.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            store.drop(f"stage{i - 1}")
    return docs
