"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
columns with clashing names, for each operator and pipeline stage."""

import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ratecast.llm import (bitplanes, diagonals, extendible, hnsw, mixing, pii_crf, risk_rules, seed_extend, simhash_ball,
                          tokens, two_fit)
from ratecast.llm.common import Scratch, components
from ratecast.llm.tokens import Encoder
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, part int, bucket string, fp string, h string"
PROSE = " ".join(f"word{(i * i) % 97} of" for i in range(60))
TEXTS = [None, "", "   \n\t ", "one", PROSE, PROSE, PROSE + " tail", " ".join(f"w{i % 7919}" for i in range(30_000)),
         "call +1 (017) 555-7713 or 555-7713, mail a.b@c.d.e%x@y.z ip 1.2.3.4 1.2.3.400 card 4111 1111 1111 1111",
         "Released under the MIT License. " * 3, "x <|endoftext|> y", "é　ü\xa0ñ  \n z"]


def corpus(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 3 else None, ["b", "a", None][i % 3], len(t) if t else None, 7, "k", 1, "b", "f", "h") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]] if len(rows) > 4 else []          # repeated rows
    rows += [(None, t, *r[2:]) for t, r in ((None, rows[0]), (PROSE, rows[-1]))] if rows else []
    return spark.createDataFrame(rows, SCHEMA), rows


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d: pii_crf.find(d), "mask": lambda d: pii_crf.mask(d), "mix": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed_documents(d), "token files": lambda d: bitplanes.token_files(d, digest=True),
    "simhash": lambda d: simhash_ball.near_duplicates(d), "one of each": lambda d: simhash_ball.keep_one(d),
    "packing": lambda d: two_fit.pack(d), "licenses": lambda d: diagonals.scan(d), "shards": lambda d: extendible.shards(d),
    "substrings": lambda d: seed_extend.remove_repeats(d), "rules": lambda d: risk_rules.quality_rules(d, labels(d.sparkSession)),
    "good": lambda d: risk_rules.keep_good(d, labels(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", ["pii", "mix", "token files", "simhash", "licenses", "shards", "substrings", "rules"])
def test_one_row_per_row(spark, name):
    docs, rows = corpus(spark)
    got = OPERATORS[name](docs).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)


def test_values_on_edge_rows(spark):
    docs, rows = corpus(spark)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in pii_crf.find(docs).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(text.get(r["doc_id"], None) if r["doc_id"] is not None else ""))
        if r["doc_id"] is not None:
            assert r["base"] == want
    want = dict(zip([r[0] for r in rows], brute.substrings([(r[0], r[1]) for r in rows])))
    for r in seed_extend.remove_repeats(docs).collect():
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) == want[r["doc_id"]]
        else:
            assert r["n_removed"] == 0
    lib, start = Encoder("byte_bpe_50k.json").lib, 0
    files = sorted(bitplanes.token_files(docs).collect(), key=lambda r: r["start"])
    for r in files:
        if r["doc_id"] is not None:
            assert r["ids"] == brute.token_ids(lib, text[r["doc_id"]], 2).tobytes()
        assert r["start"] == start
        start += r["n_tokens"]
    prints = [brute.fingerprint(r[1]) for r in rows if r[0] is not None]
    want = dict(zip([r[0] for r in rows if r[0] is not None], brute.near([r[0] for r in rows if r[0] is not None], prints)))
    assert all(want[r["doc_id"]] == r["component_id"] for r in simhash_ball.near_duplicates(docs).collect() if r["doc_id"] is not None)
    for r in risk_rules.quality_rules(docs, labels(spark, [(4, 1, 0), (4, 0, 0), (99, 1, 0), (None, 1, 0), (5, None, 0)])).collect():
        if r["doc_id"] is not None:
            q = brute.quality(text[r["doc_id"]])
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == q
            assert r["kept"] == (not q[5])


def test_stages_keep_columns(spark, tmp_path):
    docs, rows = corpus(spark)
    labels(spark, [(4, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.schema.names == [f.split()[0] for f in SCHEMA.split(", ")], name
        assert docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


@pytest.mark.parametrize("distance", [1, 3, 4, 5])
def test_ball_hashing_finds_all_links(spark, distance):
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 2 * distance + 2), replace=False):
                s = s ^ (np.uint64(1) << np.uint64(b))
            fps.add(int(s))
    fps = sorted(fps)
    if distance == 5:
        fps = fps[:20]
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    store = Scratch(spark, "t")
    edges = simhash_ball.ball_edges(table, distance, store)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= distance for r in edges.collect())
    root = {r.node: r.root for r in components(edges, store).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got, want = [root.get(f, f) for f in signed], brute.near(list(range(len(fps))), fps, distance)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("distance", [3, 4])
def test_a_large_group_of_near_copies_makes_few_edges(spark, distance):
    rng = np.random.default_rng(5)
    volatile = rng.choice(64, 14, replace=False)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(volatile, rng.integers(0, 6), replace=False)) for _ in range(900)})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    store = Scratch(spark, "t")
    edges = simhash_ball.ball_edges(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(8), distance, store)
    assert edges.count() == edges.distinct().count() <= 12 * len(fps)
    root = {r.node: r.root for r in components(edges, store).collect()}
    got, want = [root.get(f, f) for f in signed], brute.near(list(range(len(fps))), fps, distance)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_a_worker_merges_a_piece_once_and_remembers_it_in_bounds(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_MAX", 400, raising=False)
    rng, enc = np.random.default_rng(3), Encoder("byte_bpe_50k.json")
    words = ["".join(rng.choice(list("etaoins"), 7)) for _ in range(3000)]
    ends = ["", ",", ".\n\n", "\u00a0", "'s", "  ", " \u2028", "1", "\u00e9", "\t", "\u4e2d"]
    texts = [" ".join(w + ends[i % len(ends)] for i, w in zip(rng.integers(0, 60, 40).tolist() if n % 2 else [0] * 40, rng.choice(words, 40))) if n else "" for n in range(300)]
    assert enc.encode(texts) == [np.array(enc.lib.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    held = len(enc.after_blank.newer) + len(enc.after_blank.older)
    assert 0 < held <= 400 + 2 * 40 * 2

    enc, merged = Encoder("byte_bpe_50k.json"), []
    model = enc.lib.model

    class Counted:
        model = enc.lib.model
        encode = enc.lib.encode

    class Model:
        def tokenize(self, piece):
            merged.append(piece)
            return model.tokenize(piece)
    Counted.model, enc.lib = Model(), Counted
    enc.encode(["so " + " ".join(words[:100]), "so " + " ".join(w + "," for w in words[:100])])
    assert len(merged) == len(set(merged)) and sum(p[1:] in words for p in merged) == len(set(words[:100]))
    assert len(enc.after_blank.newer) == 2 * len(set(words[:100])) and list(enc.inner.newer) == ["so", ","]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (7, 256), (4096, 50257), (10_001, 2**32 - 1)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        assert (bitplanes.restore_planes(bitplanes.shuffle_planes(ids, 4096, bits), n, 4096, bits) == ids).all()


def test_two_fit_beats_greedy_and_uses_every_piece():
    # greedy fills 70 + 25 and leaves 5; 16 + 14 in place of 25 fill it all
    assert two_fit.patterns({70: 1, 25: 1, 16: 1, 14: 1}, 100)[0][0] == [70, 16, 14]
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 2049), 300, replace=False), rng.integers(1, 50, 300))}
    found = two_fit.patterns(counts, 2048)
    used = {}
    for bin_, times in found:
        assert sum(bin_) <= 2048
        for size in bin_:
            used[size] = used.get(size, 0) + times
    assert used == counts
    left, greedy = dict(counts), 0  # the same without the replacement
    while any(left.values()):
        have = np.zeros(2049, int)
        for k, v in left.items():
            have[k] = v
        for size in two_fit._fill(have, 2048):
            left[size] -= 1
        greedy += 1
    assert sum(t for _, t in found) <= 1.005 * greedy


def test_shards_split_and_page(spark):
    rows = [(i, "x" * (50 + i % 100), "s") for i in range(500)] + [(7, "same", "s")] * 300 + [(1, "y" * 5000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = extendible.shards(docs, max_bytes=1000).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r["depth"], r["prefix"], r["page"]), []).append(r)
    for (depth, prefix, _), some in by.items():
        assert len(prefix) == depth and len(some) == some[0]["shard_docs"]
        assert sum(r["n_bytes"] for r in some) == some[0]["shard_bytes"]
        assert some[0]["shard_bytes"] <= 1000 or len(some) == 1
    prefixes = sorted({p for _, p, _ in by})
    assert not any(b.startswith(a) for a, b in zip(prefixes, prefixes[1:]))


def test_exact_binomial_bound_and_cutoff():
    assert abs(risk_rules.binomial_upper(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9
    assert abs(risk_rules.binomial_upper(3, 50, 0.05) - 0.1478) < 1e-3
    bins, good = np.array([100, 500]), np.array([5.0, 2995.0])
    assert risk_rules.choose_cutoff(bins, good, 0.01, 0.05) == 500
    assert risk_rules.choose_cutoff(bins, np.array([60.0, 2940.0]), 0.01, 0.05) == 100
    assert risk_rules.choose_cutoff(bins, np.array([1.0, 9.0]), 0.01, 0.05) == 0


def test_false_rejection_is_limited_on_fresh_documents():
    rng = np.random.default_rng(0)
    worst = 0
    for _ in range(40):
        hold, fresh = (np.clip(rng.normal(600, 80, n).astype(int), 0, 1000) for n in (2000, 20_000))
        b, n = np.unique(hold, return_counts=True)
        cut = risk_rules.choose_cutoff(b, n.astype(float), 0.01, 0.05)
        worst += (fresh < cut).mean() > 0.01
    assert worst <= 5


def test_skip_edges_carry_labels_to_repeats():
    texts = [f"call +1 (0{i:02d}) 555-{1000 + i} now, a{i}@b.cd, see {i}.0 and {i * 13 % 700} more" for i in range(300)]
    model = pii_crf.train(texts)
    base, spans = pii_crf.all_spans(["mail +1 (017) 555-7713 and much later 555-7713 again, version 2.0 of 12 items"], model)[0]
    assert [k for k, _, _ in base] == [3] and set(base) < set(spans)
    assert all(pii_crf.KINDS[k] == "phone" for k, _, _ in spans) and len(spans) == 2


def test_long_license_with_changes_is_found():
    known = diagonals._templates(diagonals.PHRASES, diagonals.TEMPLATES)
    words = ("noise words first " + diagonals.TEMPLATES[0][1].replace("free of charge", "without fee") + " and more").encode().split()
    from ratecast.llm.common import gram_hashes, word_hashes
    grams = gram_hashes(word_hashes(words), 3).tolist()
    found = {}
    for t, (_, template, _) in enumerate(known):
        for p, h in enumerate(gram_hashes(word_hashes(template), 3).tolist()):
            for pos in (i for i, g in enumerate(grams) if g == h):
                lo, hi = found.get((t, pos - p), (pos, pos))
                found[t, pos - p] = (min(lo, pos), max(hi, pos))
    spans = diagonals.verify(words, [(t, d, lo, hi) for (t, d), (lo, hi) in found.items()], known)
    assert [(known[t][0], a) for t, a, _, s in spans if s > 0.8] == [("mit", 3)]


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [inf, 0.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0], 1), (1, [1.0, 0.0], 1)]
    got = hnsw.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    one = {r["vec_id"]: r for r in got}
    assert {i: one[i]["component_id"] for i in (0, 1, 2)} == {0: 0, 1: 0, 2: 0} and one[0]["n_links"] == 3
    assert all(one[i]["n_links"] == 0 and one[i]["component_id"] == i and one[i]["kept"] for i in range(3, 12))
    assert hnsw.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_letters_alone_are_learned_without_the_split(monkeypatch):
    split, seen = tokens.SPLIT, []

    class Split:
        def findall(self, text):
            seen.append(text)
            return split.findall(text)
    monkeypatch.setattr(tokens, "SPLIT", Split())
    enc = Encoder("byte_bpe_50k.json")
    texts = ["so it was, über café ª don't ab1 中文 x\ny ŉo ƻz", "so it's, was 12 été"]
    assert enc.encode(texts) == [np.array(enc.lib.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    split_units = {u for t in seen for u in t.split(" ")}
    assert "was," in split_units and not split_units & {"it", "was", "über", "café", "ª", "ŉo", "ƻz", "été"}


def test_quality_holds_little_beside_a_batch():
    import tracemalloc

    import pyarrow as pa

    from ratecast.llm import common
    rng = np.random.default_rng(5)
    words = np.array(["w%x" % i for i in range(30_000)])
    texts = pa.array([" ".join(rng.choice(words, 400)) for _ in range(3_000)] + [None, ""])
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(["en"] * len(texts)), texts], names=["doc_id", "key", "stratum", "text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in risk_rules._features([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 80e6 and not common._MEMO
