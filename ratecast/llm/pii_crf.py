"""Personal data by fixed patterns and a skip-chain conditional random field.

The four base patterns run over every whole text.  On top, each text that
has a digit, an at sign or a plus sign becomes a graph: its nodes are the
blank-separated tokens that hold one of these (the tag dictionary gives
every other token the label O, which cuts the chain exactly there), chain
edges join neighbouring nodes, and skip edges join each node to the
first node, however distant, with the same normal form or the same last
seven digits.  Such stars keep the edges linear in the tokens, and any two
similar tokens are two edges apart.  Damped sum-product message passing over
both edge kinds gives each node's label; each text's messages are passed
until none would move by more than ``TOLERANCE`` at full step, whatever
other texts are in the batch.  The step halves every ``PATIENCE`` rounds, and
a text that has not settled after ``ROUNDS`` keeps its base spans alone.
Labelled tokens outside all base spans are added as spans, neighbours in the
chain with one label as one span.

Node, chain and skip weights are fitted together by pseudo-likelihood on a
bounded sample of texts (``TRAIN_DOCS``, by smallest hash, up to
``TRAIN_CHARS`` characters of each), labelled by the base patterns.  Each
token enters the fit twice: with its features and neighbours, and with all
but its number of digits and its skip partners hidden, so that a mention
that no pattern knows can be told by its partners.  Tokens that
a skip star joins to a mention but no pattern labels are left out of the fit.

Defined cases: a null text is empty and has no spans; repeated rows get
equal results; ties between labels go to the first of O, email, ip, card,
phone; an empty table gives an empty result; only ``doc_id`` and ``text``
are read, and ``mask`` keeps every other column whatever its name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratecast.llm.tokens import batches_of_texts

KINDS = ("email", "ip", "card", "phone")
USER = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, which the lookbehind
# says outright so that long runs are not tried at each digit
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@+]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+")
DIGITS = re.compile(r"[0-9]")

TRAIN_DOCS = 1_000   # bound of the sample that the weights are fitted on
TRAIN_CHARS = 20_000 # of a text in that sample
HASHED = 1 << 13     # node features
HIDDEN = HASHED      # stands for a feature that is left out
LABELS = 1 + len(KINDS)
TOLERANCE = 1e-4     # largest move of a message, at full step, at which a text is settled
PATIENCE = 50        # rounds of message passing until the step halves
ROUNDS = 600
STEP = 0.5
SURE = 0.9           # probability from which a label becomes a span
RUN_BYTES = 2_000_000 # of texts held as strings at a time
BATCH_NODES = 20_000 # tokens whose messages are passed together, about


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of user@host, found from the at
    signs so that the cost is linear in the text."""
    pos, at = 0, text.find("@")
    while at >= 0:
        user = text[max(pos, text.rfind(" ", pos, at) + 1):at]
        size = len(user) - len(user.rstrip(USER))
        m = HOST.match(text, at + 1) if size else None
        if m:
            yield at - size, m.end()
        pos = m.end() if m else at + 1
        at = text.find("@", pos)


def is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    if not MARK.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out.extend((1, *m.span()) for m in IP.finditer(text) if is_ip(m[0]))
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", token[:80])
    return re.sub(r"[^\W\d_]+", "a", s)


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % HASHED


class Graph:
    """Nodes, features, chain and skip edges of one or more texts."""

    def __init__(self):
        self.spans, self.owner, self.feats, self.hidden, self.chain, self.skip = [], [], [], [], [], []

    def add(self, owner: int, text: str) -> None:
        last_end, last, seen = -2, -1, {}
        for m in TOKEN.finditer(text):
            node, token = len(self.spans), m[0]
            self.spans.append(m.span())
            self.owner.append(owner)
            near = last >= 0 and m.start() - last_end == 1
            shape = _shape(token)
            digits = "".join(DIGITS.findall(token))
            cut = token.strip(".,;:!?()[]\"'*#$%&|<>")
            feats = [f"s:{shape}", f"p:{_shape(cut)}", f"n:{min(len(digits), 24)}",
                     f"c:{len(digits)}:{luhn(digits)}" if 12 <= len(digits) <= 19 else "c",
                     f"i:{bool(IP.fullmatch(cut)) and is_ip(cut)}"]
            self.feats.append([_bucket(f) for f in feats])
            self.hidden.append([HIDDEN, HIDDEN, self.feats[-1][2], HIDDEN, HIDDEN])  # the number of digits alone
            if near:
                self.chain.append((last, node))
            for key in {cut.lower(), digits[-7:] if len(digits) >= 7 else cut.lower()}:
                if len(key) >= 4:
                    if key in seen:
                        self.skip.append((seen[key], node))
                    else:
                        seen[key] = node
            last_end, last = m.end(), node


def _edges(pairs) -> np.ndarray:
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


class Model:
    def __init__(self, node, chain, skip):
        self.node, self.chain, self.skip = node, chain, skip

    def label(self, g: Graph) -> tuple[np.ndarray, np.ndarray]:
        """Best label and its probability per node, by loopy message passing;
        label 0 for all nodes of a text whose messages do not settle."""
        score = self.node[np.array(g.feats)].sum(axis=1)
        chain, skip = _edges(g.chain), _edges(g.skip)
        src = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        dst = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        nc, ns = len(chain), len(skip)
        tables = np.stack([self.chain, self.chain.T, self.skip])
        kind = np.repeat([0, 1, 2], [nc, nc, 2 * ns])
        back = np.concatenate([np.arange(nc, 2 * nc), np.arange(nc), 2 * nc + np.arange(ns, 2 * ns), 2 * nc + np.arange(ns)])
        msg = np.zeros((len(src), LABELS))
        node_owner = np.array(g.owner, dtype=np.int64)
        owner, texts = node_owner[src], node_owner.max() + 1
        live, rounds = np.arange(len(src)), 0
        while len(live) and rounds < ROUNDS:
            step = STEP * 0.5 ** (rounds // PATIENCE)
            belief = score.copy()
            np.add.at(belief, dst[live], msg[live])
            out = (belief[src[live]] - msg[back[live]])[:, :, None] + tables[kind[live]]
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            move = np.zeros(texts)
            np.maximum.at(move, owner[live], np.abs(new - msg[live]).max(axis=1))
            msg[live] = (1 - step) * msg[live] + step * new
            live, rounds = live[move[owner[live]] > TOLERANCE], rounds + 1
        belief = score.copy()
        np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        restless = np.zeros(texts, bool)
        restless[owner[live]] = True
        return np.where(restless[node_owner], 0, p.argmax(axis=1)), p.max(axis=1)


def train(texts: list[str], steps: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Pseudo-likelihood fit on texts that the base patterns label."""
    g, y = Graph(), []
    for i, t in enumerate(texts):
        first = len(g.spans)
        g.add(i, t)
        base = base_spans(t)
        for a, b in g.spans[first:]:
            y.append(next((k + 1 for k, s, e in base if s < b and a < e), 0))
    node, chain, skip = np.zeros((HASHED + 1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    node[:HIDDEN, 0] = 0.05
    if not y:
        return Model(node, chain, skip)
    y, c, s = np.array(y), _edges(g.chain), _edges(g.skip)
    # a partner of a mention that no pattern labels is neither a mention nor none: it stays out of the fit
    linked = y > 0
    for _ in range(2):  # over the star's centre
        linked = linked | np.isin(np.arange(len(y)), np.concatenate([s[linked[s[:, 0]], 1], s[linked[s[:, 1]], 0]]))
    open_ = linked & (y == 0)
    # every token a second time with its tell-tale features and its chain hidden
    sure = np.flatnonzero(~open_)
    f = np.concatenate([np.array(g.feats)[sure], np.array(g.hidden)[sure]])
    which = np.concatenate([sure, sure])
    hot = np.eye(LABELS)[y] * ~open_[:, None]
    before, after, like = np.zeros((len(y), LABELS)), np.zeros((len(y), LABELS)), np.zeros((len(y), LABELS))
    np.add.at(before, c[:, 1], hot[c[:, 0]])
    np.add.at(after, c[:, 0], hot[c[:, 1]])
    np.add.at(like, s[:, 1], hot[s[:, 0]])
    np.add.at(like, s[:, 0], hot[s[:, 1]])
    before, after, like, hot = before[which], after[which], like[which], hot[which]
    before[len(sure):] = after[len(sure):] = 0
    grads = [np.full_like(x, 1e-8) for x in (node, chain, skip)]
    for _ in range(steps):
        z = node[f].sum(axis=1) + before @ chain + after @ chain.T + like @ skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (hot - p) / len(hot)
        gn = np.zeros_like(node)
        for j in range(f.shape[1]):
            np.add.at(gn, f[:, j], d)
        gn[HIDDEN] = 0
        gs = like.T @ d
        for w, grad, total in zip((node, chain, skip), (gn, before.T @ d + d.T @ after, (gs + gs.T) / 2), grads):
            grad = grad - ridge * w / len(hot)
            total += grad * grad
            w += rate * grad / np.sqrt(total)
    return Model(node, chain, skip)


def added_spans(g: Graph, model: Model) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) per owner of the tokens that the field labels."""
    out: dict[int, list] = {}
    if not g.spans:
        return out
    label, sure = model.label(g)
    for node in np.flatnonzero((label > 0) & (sure >= SURE)).tolist():
        (a, b), kind = g.spans[node], int(label[node]) - 1
        mine = out.setdefault(g.owner[node], [])
        if mine and mine[-1][0] == kind and a - mine[-1][2] == 1:
            a = mine.pop()[1]
        mine.append((kind, a, b))
    return out


def all_spans(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """Base spans and all spans per text, each by kind and start.  Messages
    are passed over about ``BATCH_NODES`` tokens at a time (a text stays whole)."""
    bases, more, g = [base_spans(t) for t in texts], {}, Graph()
    for i, t in enumerate(texts):
        if MARK.search(t):
            g.add(i, t)
        if g.spans and (len(g.spans) >= BATCH_NODES or i == len(texts) - 1):
            g.owner = (np.array(g.owner) - (first := g.owner[0])).tolist()
            more.update((first + k, v) for k, v in added_spans(g, model).items())
            g = Graph()
    out = []
    for i, base in enumerate(bases):
        new = [x for x in more.get(i, ()) if not any(s < x[2] and x[1] < e for _, s, e in base)]
        out.append((base, sorted(base + new)))
    return out


def text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """Weights from at most ``train_docs`` distinct texts with marks, those
    with the smallest hashes.  The hashes alone are ordered; then these texts
    are fetched, each up to ``train_chars`` characters (the fit alone reads
    less than a whole text)."""
    draw = F.xxhash64("text", F.lit(5))
    some = docs.select("text", draw.alias("h")).where(F.col("text").rlike("[0-9@+]"))
    drawn = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(train_docs).collect()]
    if not drawn:
        return train([])
    cut = some.where(F.col("h").isin(drawn)).select("h", F.substring("text", 1, train_chars).alias("text"))
    one = cut.withColumn("n", F.row_number().over(W.partitionBy("h").orderBy("text"))).where("n = 1")
    return train([r["text"] for r in one.select("text", "h").orderBy("h").collect()])


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, base, spans) per row: strings of kind:start:end."""
    model = model or fit(docs)

    def run(batches):
        for batch in batches:
            for at, texts in batches_of_texts(batch, 1, RUN_BYTES):
                found = all_spans(texts, model)
                counts = [Counter(k for k, _, _ in b) for b, _ in found]
                cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *cols, pa.array([text_of(b) for b, _ in found], pa.string()),
                     pa.array([text_of(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string")


def masked(text: str, spans) -> str:
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Model | None = None, length_col: str | None = "n_chars") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; the
    length column, if there, gets the new length where a text changed."""
    model = model or fit(docs)
    names = docs.columns
    at = names.index("text")
    n_at = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in batches:
            raw = batch.column(at).to_pylist()
            new = [None if t is None else masked(t, s) for t, (_, s) in zip(raw, all_spans([t or "" for t in raw], model))]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            if n_at is not None:
                was = cols[n_at].to_pylist()
                cols[n_at] = pa.array([w if a == b else len(b) for w, a, b in zip(was, raw, new)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
