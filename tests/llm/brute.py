"""Plain single-machine versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(n, linked):
    """Smallest member of each index's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(s[0::2] + [sum(divmod(2 * x, 10)) for x in s[1::2]]) % 10 == 0


def pii(text):
    t = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def fingerprint(text, k=4):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(ids, prints, distance=4):
    fp = np.array(prints, dtype=np.uint64)
    pairs = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= distance).tolist() if j > i]
    root = groups(len(ids), pairs)
    low = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, ids[i]), ids[i])
    return [low[r] for r in root]


def token_ids(lib, text, end):
    return np.array([*lib.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def license_base(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in phrases for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    return (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))


def quality(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if count[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def substrings(docs, span=13):
    """{index: (words, removed, sha)} of [(doc_id, text)]."""
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - span + 1):
            if d is not None:
                key = tuple(w[i:i + span])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - span + 1) if d is not None and first[tuple(w[i:i + span])] < d for j in range(i, i + span)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def cosine_links(rows, threshold=0.93):
    """[(links, component)] of [(vec_id, vector, label)]."""
    pairs = []
    for i, (_, a, la) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            _, b, lb = rows[j]
            if la is None or la != lb or not a or not b or len(a) != len(b):
                continue
            x, y = np.array([np.nan if v is None else v for v in a]), np.array([np.nan if v is None else v for v in b])
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                pairs.append((i, j))
    n = Counter(i for p in pairs for i in p)
    root = groups(len(rows), pairs)
    low = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return [(n[i], low[r]) for i, r in enumerate(root)]
