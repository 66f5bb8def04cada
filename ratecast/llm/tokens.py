"""Token ids of whole texts by the tokenizers library.

The byte-level vocabularies split a text before merging, and no split token
reaches over the point before a single blank between two other characters
that are no white space.  A text is cut at these points, each distinct unit
is encoded once by the library, and a worker remembers units it has seen in
a bounded memory, from which those fall that were not met for long.
A text that holds a special token's own string is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MEMO_MAX = 540_000      # units a worker remembers, some 260 bytes each,
INNER_MAX = 60_000      # and pieces from within units
RUN_BYTES = 2_000_000   # of texts encoded together
_ENCODERS: dict = {}

# The split of the byte-level vocabularies, and the characters
# on whose classes all regular expression engines agree.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile(r"[^\n!-~\u00a1-\u024f]")
UNEVEN = re.compile(r"[^\n -~\u00a1-\u024f]|[ \n] | \n")  # in blanks around units: one is empty, unusual or has white space


def byte_letters() -> dict[int, str]:
    """Byte to letter of the byte-level alphabet: printable bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = "".join(letter for _, letter in sorted(byte_letters().items()))


def _letters(piece: str) -> str:
    """A piece of the split in the byte-level alphabet."""
    return charmap_decode(piece.encode(), "strict", _LETTERS)[0]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file on this machine (driver or executor)."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Memory:
    """A bounded memory in two halves.  What is asked for moves to the newer
    one; when that is full, the older one is dropped and takes its place."""

    def __init__(self, most: int):
        self.most = most
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.newer.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.newer[key] = found
        return found

    def make_room(self) -> None:
        if len(self.newer) > self.most // 2:
            self.newer, self.older = {}, self.newer


class Encoder:
    """Ids as little-endian bytes of the narrower of 16 and 32 bits that holds the vocabulary."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(name if os.sep in name else vocabulary(name))
        self.size = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        pre = str(self.lib.pre_tokenizer)
        self.cuts = "ByteLevel" in pre and "add_prefix_space=False" in pre and self.lib.normalizer is None
        self.inner = Memory(INNER_MAX)       # piece of the split that begins without a blank: ids
        self.after_blank = Memory(MEMO_MAX)  # unit that a blank precedes, without it: ids with the blank

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, units: list[str]) -> None:
        """Encode units that have no blank and no white space at their ends.
        Letters alone are one piece of the split.  Over other units it runs
        many at once (a unit begins where a piece begins with a blank), and
        the library's model merges each distinct piece; units with unusual
        characters go through the whole library."""
        unusual = set(filter(UNUSUAL.search, units)) if UNEVEN.search(" ".join(units)) else set()
        known = self.after_blank.newer
        known.update((u, self._ids(" " + u).tobytes()) for u in unusual)
        usual = [u for u in units if u not in unusual] if unusual else units
        merge, code = self.lib.model.tokenize, self.code
        mixed = []
        for u in usual:
            if not u.isalpha():
                mixed.append(u)
            elif u not in known:  # else a piece of another unit
                letters = "\u0120" + u if u.isascii() else _letters(" " + u)
                known[u] = array(code, [t.id for t in merge(letters)]).tobytes()
        for i in range(0, len(mixed), 20_000):
            some = mixed[i:i + 20_000]
            pieces = SPLIT.findall(" " + " ".join(some))
            ids = self._merge(pieces)
            at = [j for j, p in enumerate(pieces) if p[0] == " "]
            parts = [ids[p] for p in pieces]
            known.update(zip(some, [b"".join(parts[a:b]) if b - a > 1 else parts[a] for a, b in zip(at, [*at[1:], len(parts)])]))

    def _merge(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of these pieces of the split.  A piece that begins with a
        blank is itself a unit and is remembered as such."""
        merge, code, out = self.lib.model.tokenize, self.code, {}
        units, older, inner = self.after_blank.newer, self.after_blank.older, self.inner
        for p in set(pieces):
            if p[0] == " ":
                memory, key = units, p[1:]
                found = units.get(key) or older.get(key)
            else:
                memory, key = inner.newer, p
                found = inner.get(p)
            if found is None:
                letters = "\u0120" + key if memory is units and key.isascii() and "\n" not in key else _letters(p)
                found = memory[key] = array(code, [t.id for t in merge(letters)]).tobytes()
            out[p] = found
        return out

    def _first(self, unit: str) -> bytes:
        """Ids of a text's beginning, up to its first blank."""
        if UNUSUAL.search(unit):
            return self._ids(unit).tobytes()
        pieces = SPLIT.findall(unit)
        ids = self._merge(pieces)
        return b"".join([ids[p] for p in pieces])

    def _uneven(self, parts: list[str]) -> bytes:
        """A text with white space beside some of its blanks: cut at the others."""
        runs = [parts[0]]
        out = []
        for a, b in zip(parts, parts[1:]):
            if a and b and not a[-1].isspace() and not b[0].isspace():
                runs.append(b)
            else:
                runs[-1] += " " + b
        for i, r in enumerate(runs):
            known = self.after_blank.get(r) if i else None
            out.append(self._ids(" " + r if i else r).tobytes() if known is None else known)
        return b"".join(out)

    def _cut(self, text: str) -> bytes:
        """Ids of a text, unit by unit."""
        self.after_blank.make_room()
        self.inner.make_room()
        first, *parts = text.split(" ")
        known = self.after_blank.newer
        uneven = not first or first[-1].isspace()
        missing = set(parts).difference(known)
        if missing:
            older = self.after_blank.older
            known.update([(x, older[x]) for x in missing if x in older])
            new = [x for x in missing if x not in known]
            if new and UNEVEN.search(f" {' '.join(new)} "):
                odd = {x for x in new if not x or x[0].isspace() or x[-1].isspace()}
                uneven = uneven or bool(odd)
                new = [x for x in new if x not in odd]
            self._learn(new)
        return self._uneven([first, *parts]) if uneven else self._first(first) + b"".join(map(known.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        return [b"" if not t else self._cut(t) if self.cuts and not any(s in t for s in self.special) else self._ids(t).tobytes() for t in texts]


def encoder(name: str, remembered: int | None = None) -> Encoder:
    """This worker's encoder of a vocabulary file, which remembers as many units (``MEMO_MAX``)."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    _ENCODERS[name].after_blank.most = remembered or MEMO_MAX
    return _ENCODERS[name]


def batches_of_texts(batch: pa.RecordBatch, column: int, most: int = RUN_BYTES):
    """(first row, texts) of a batch in runs of at most ``most`` bytes (a longer
    text stands alone); null is empty.  Only one run is held as strings."""
    texts = batch.column(column)
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate([*size.tolist(), most + 1]):
        if i > first and held + n > most:
            yield first, [t or "" for t in texts.slice(first, i - first).to_pylist()]
            first, held = i, 0
        held += n
