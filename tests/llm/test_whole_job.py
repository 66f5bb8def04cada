"""Operators do the whole job where a cut would go unseen on small tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratecast.llm import diagonals, hnsw, pii_crf, risk_rules, seed_extend
from ratecast.llm.common import Scratch, gram_hashes, row_key, word_hashes


def planted(n, dim, seed):
    """Vectors of one label in small groups of near copies, and all true links by brute force."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 3):
        x[i:i + 3] = x[i] + rng.normal(0, 0.22, (len(x[i:i + 3]), dim))
    x = x[rng.permutation(n)]
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = [np.flatnonzero(u @ v >= hnsw.THRESHOLD) for v in u]
    return x, {(i, int(j)) for i, js in enumerate(near) for j in js if i != j}


def test_links_across_shards_of_production_size(spark):
    n = 2 * hnsw.SHARD + 3_000
    x, true = planted(n, 32, 3)
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in hnsw.links(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    want = np.bincount([i for i, _ in true], minlength=n)
    found = np.array([got[i] for i in range(n)])
    assert len(true) > 5_000 and (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_audit_sees_queries_of_other_shards_and_no_hits_on_itself(monkeypatch):
    x, _ = planted(900, 16, 5)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    graph = hnsw.Graph(x[:600])
    whole = hnsw.Graph.within

    def only_itself(self, q, threshold, beam, own=None):
        if beam >= len(self.x):
            return whole(self, q, threshold, beam, own)
        return (np.arange(len(q)), own) if own is not None else (np.empty(0, np.int64),) * 2

    monkeypatch.setattr(hnsw.Graph, "within", only_itself)
    few = np.eye(130)
    few[1] = few[0]
    assert hnsw.audited(hnsw.Graph(few), few, True, hnsw.THRESHOLD) == 130  # the only link is missed
    assert hnsw.audited(graph, x[:600], True, hnsw.THRESHOLD) == 600
    assert hnsw.audited(graph, x[600:], False, hnsw.THRESHOLD) == 600


def test_links_between_shards_count_at_both_ends(monkeypatch):
    """Links that only one end finds: n_links stays symmetric."""
    x, true = planted(300, 16, 7)
    whole = hnsw._found

    def one_sided(graph, q, threshold, beam, own):
        hit = whole(graph, q, threshold, len(graph.x), own)
        return hit if q[0, 0] < graph.x[0, 0] else np.zeros_like(hit)

    monkeypatch.setattr(hnsw, "_found", one_sided)
    row = np.concatenate([np.arange(0, 300, 2), np.arange(1, 300, 2)])
    table = pa.table({"row": row, "vec_id": row, "shard": np.repeat([0, 1], 150).astype(np.int32), "h": row,
                      "v": pa.array(x[row].tolist(), pa.list_(pa.float64()))})
    out = hnsw.answer(table, hnsw.THRESHOLD, 0.98, 1, 0, 1).to_pydict()
    got = {r: n for r, n in zip(out["row"], out["n"]) if r is not None}
    across = [(i, j) for i, j in true if i % 2 != j % 2]
    assert across and got == {int(i): int(n) for i, n in enumerate(np.bincount([i for i, _ in across], minlength=300)) if n}


def test_evidence_reaches_every_mention_of_a_long_text():
    """One mention is recognisable, all others only by their likeness to it."""
    node = np.zeros((pii_crf.HASHED, pii_crf.LABELS))
    node[pii_crf._bucket("s:+98"), 4] = 8
    model = pii_crf.Model(node, np.zeros((pii_crf.LABELS,) * 2), 5 * np.eye(pii_crf.LABELS))
    for times in (1, 40, 400):
        text = "call +15557713 first" + ", and then again 555-7713 with more words" * times
        assert len(pii_crf.all_spans([text], model)[0][1]) == 1 + times
    alone, batch = pii_crf.all_spans([text], model), pii_crf.all_spans([text, "see 555-7713 or 1.2.3.400", text], model)
    assert batch[0] == batch[-1] == alone[0]


def test_messages_that_circle_settle():
    """Skip edges that push like tokens apart, in triangles: no fixed labels, but an end."""
    model = pii_crf.Model(np.zeros((pii_crf.HASHED, pii_crf.LABELS)), -20 * np.eye(pii_crf.LABELS), -20 * np.eye(pii_crf.LABELS))
    model.node[pii_crf._bucket("s:93-94"), 1:3] = 3
    assert pii_crf.all_spans(["555-7713 555-7713 555-7714 555-7713 555-7714 " * 20], model)


def test_rare_texts_with_marks_still_reach_the_training_bound(spark, monkeypatch):
    docs = spark.range(40_000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("call "), "id")).otherwise("plain").alias("text"))
    drawn = []
    monkeypatch.setattr(pii_crf, "train", lambda texts: drawn.extend(texts))
    pii_crf.fit(docs, 100)
    assert len(set(drawn)) == 100


def test_a_frequent_phrase_in_different_texts_is_split(spark):
    """A phrase that anchors a third of all windows fills no bucket; results stay right."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30_000)]
    low = int(np.argmin(gram_hashes(word_hashes([w.encode() for w in words]), 5)))
    phrase = words[low:low + 5]
    texts = [" ".join([*rng.choice(words, 12), *phrase, *rng.choice(words, 8)]) for _ in range(3_000)]
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    hot = seed_extend.frequent_anchors(rows, Scratch(spark, "hot"), len(texts), 8)

    def most(anchors):
        per = seed_extend.packed(rows, anchors, 9).groupBy("bucket").agg(F.sum(F.octet_length("window")).alias("n"))
        return per.agg(F.max("n") / F.sum("n")).first()[0]

    assert len(hot) == 1 and most(hot[:0]) > 0.3 and most(hot) < 0.02
    got = {r["doc_id"]: r["n_removed"] for r in seed_extend.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [0] * 3_000 + [25] * 20


def test_similar_licences_are_told_apart(spark):
    """Of texts that share most words, the licence that explains more of them is named; changed words are bridged."""
    cc = "Licensed under a Creative Commons Attribution{} 4.0 International License."
    mit = diagonals.TEMPLATES[0][1]
    texts = [cc.format(""), cc.format("-NonCommercial"), cc.format("-NonCommercial-ShareAlike"), cc.format("-NoDerivatives"),
             next(t for label, t in diagonals.TEMPLATES if label == "lgpl"), mit.replace("free of charge", "without fee").replace("merge publish", "publish"),
             mit + " more words " + mit, "plain words of the software and of the license", None]
    rows = diagonals.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["labels"] for r in rows}
    assert got == {0: "cc-by", 1: "cc-by-nc", 2: "cc-by-nc-sa", 3: "cc-by-nd", 4: "lgpl", 5: "mit", 6: "mit", 7: "", 8: ""}
    assert next(r["spans"] for r in rows if r["doc_id"] == 6).count("mit:") == 2 and 0.9 < next(r["score"] for r in rows if r["doc_id"] == 5) < 1
    with pytest.raises(ValueError):
        diagonals.scan(spark.createDataFrame([], "doc_id long, text string"), phrases=(("cc by", "cc-by"),))


def test_copies_lie_on_one_side_and_count_once(spark):
    """Twins of one text, exact and near, are one draw of the holdout."""
    words = [f"w{i}" for i in range(4000)]
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(words, 80)) for _ in range(40)]
    near = [t + " tail" for t in base]
    texts = base + near + base[:5] * 40
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    truth = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, good int")
    known = risk_rules.grouped(docs, risk_rules.features(docs).join(truth, "doc_id"), truth)
    rows = [(r["doc_id"], r["unit"], r["half"]) for r in known.select("doc_id", "unit", "half").collect()]
    unit = {i: u for i, u, _ in rows}
    assert len(rows) == len(texts) and all(unit[i] == unit[80 + 40 * 0 + i] for i in range(5)) and len({u for _, u, _ in rows}) <= 80
    side = {}
    assert all(side.setdefault(u, h) == h for _, u, h in rows) and set(side.values()) == {0, 1}
    assert risk_rules.one_of_each(known).count() == len(set(unit.values()))


def test_hidden_mentions_are_found_by_their_partners(spark):
    """Numbers that no pattern knows, planted as repeats of recognisable ones in
    texts like the table's: precision and recall of the added spans."""
    rng = np.random.default_rng(4)
    word = [f"{a}{b}" for a in ("que", "les", "und", "the", "ou") for b in ("r", "lle", "nt", "s", "er")]
    say = lambda n: " ".join(rng.choice(word, n))
    number = lambda: f"{rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
    texts, hidden = [], []
    for i in range(900):
        line = number()
        full = f"+1 ({rng.integers(100, 999)}) {line}"
        text = f"{say(8)} {full} {say(5)} {number()} {say(4)} "  # the second is an order number of the same shape
        if i % 3 == 0:
            text += f"{full} {say(3)} "
        elif i % 3 == 1:
            hidden.append((i, "phone", len(text), len(text) + len(line)))
            text += f"{line} {say(5)} "
        texts.append(text + f"{rng.integers(1, 30)}.{rng.integers(1, 30)} {say(3)}")
    found = pii_crf.all_spans(texts, pii_crf.train(texts[:450]))
    added = {(i, pii_crf.KINDS[k], a, b) for i, (base, spans) in enumerate(found) for k, a, b in set(spans) - set(base)}
    right = len(added & set(hidden))
    assert right >= 0.95 * len(hidden) and right >= 0.95 * len(added)


def test_unsettled_texts_keep_their_base_spans(monkeypatch):
    monkeypatch.setattr(pii_crf, "ROUNDS", 3)
    model = pii_crf.Model(np.zeros((pii_crf.HASHED, pii_crf.LABELS)), -20 * np.eye(pii_crf.LABELS), -20 * np.eye(pii_crf.LABELS))
    model.node[pii_crf._bucket("s:93-94"), 1:3] = 3
    (base, spans), = pii_crf.all_spans(["mail a@b.cd 555-7713 555-7713 555-7714 555-7713 555-7714 " * 20], model)
    assert base and spans == base
