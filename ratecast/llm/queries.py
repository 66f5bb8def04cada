"""The operators over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecast.llm import (bitplanes, diagonals, extendible, hadamard, hnsw, mixing, pii_crf, risk_rules, robust_graph, seed_extend,
                          simhash_ball, threshold_lists, two_fit)
from ratecast.plans.tables import table


def op1_pii(spark, sf):
    found = pii_crf.find(table(spark, sf, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op2_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_bitplanes(spark, sf):
    return bitplanes.token_files(table(spark, sf, "documents"), digest=True)


def op4_simhash(spark, sf):
    rows = simhash_ball.near_duplicates(table(spark, sf, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark, sf):
    return two_fit.pack(table(spark, sf, "documents"), with_ids=False)


def op6_licenses(spark, sf):
    return diagonals.scan(table(spark, sf, "documents"))


def op7_sharding(spark, sf):
    return extendible.shards(table(spark, sf, "documents"))


def op8_substrings(spark, sf):
    rows = seed_extend.remove_repeats(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_embeddings(spark, sf):
    return hnsw.links(table(spark, sf, "embeddings"))


def op10_quality(spark, sf):
    rows = risk_rules.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_centroids(spark, sf):
    return hadamard.clusters(table(spark, sf, "embeddings"))


def op12_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return threshold_lists.hard_negatives(table(spark, sf, "embeddings").withColumn("label", label))


def op13_neighbours(spark, sf):
    return robust_graph.neighbours(table(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_bitplanes, op4_simhash, op5_packing, op6_licenses, op7_sharding,
                                   op8_substrings, op9_embeddings, op10_quality, op11_centroids, op12_negatives, op13_neighbours)}
ORACLES = {"op2_mixing": mixing.SQL, "op7_sharding": extendible.SQL, "op8_substrings": seed_extend.SQL, "op9_embeddings": hnsw.SQL,
           "op11_centroids": hadamard.SQL, "op12_negatives": threshold_lists.SQL}
