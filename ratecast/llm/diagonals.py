"""License scans by diagonal voting.

Every rolling ``k``-word gram of every text is joined, in Spark, to the
positions of the templates' grams (a fixed list of some hundred rows, so it
is broadcast).  A hit votes for its diagonal, the offset between text and
template; votes are summed per document, template and diagonal.
Neighbouring diagonals, up to ``SLACK`` words apart and near in the text,
are merged, which bridges inserted and missing words.  Each merged span is
verified against the words themselves: the longest common subsequence with
the template must cover ``COVERAGE`` of it.

The phrases are templates of their own that must stand word for word; each
place is a full diagonal.  Of the longer templates a span names the label
with its coverage as score; a phrase's score is 1.

Defined cases: null and empty texts have no words, no label and score 0;
repeated rows get equal results; of the longer templates' spans that overlap
by more than half the one with the most words in common counts; a phrase or
template of fewer than ``k`` words is refused; an empty table gives an empty result; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecast.llm.common import Scratch, gram_hashes, row_key, slices, text_bytes, word_hashes

GRAM = 3
SLACK = 3
COVERAGE = 0.75
BLOCK = 8_192           # grams a row carries to Spark
BROADCAST_ROWS = 500_000  # candidate diagonals up to which they are broadcast to the texts

# The phrases that must stand word for word, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Longer templates, the words of public licences and of the notices that name them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the rights "
            "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
            "the software is furnished to do so subject to the following conditions"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
            "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
            "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
            "in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
            "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or "
            "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
            "negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
            "disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
            "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event "
            "shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential "
            "damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
            "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence "
            "or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                 "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
                 "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
                 "conditions of any kind either express or implied see the license for the specific language governing permissions and "
                 "limitations under the license"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
            "free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
            "merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
             "license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
             "software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
              "with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
                  "sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non "
                  "commercial and by any means"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
)

# lower case, and a blank for all that is no digit, letter or beyond ASCII
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _templates(phrases, templates) -> list[tuple[str, list[bytes], bool]]:
    """(label, words, must be exact)."""
    return [(label, t.encode().split(), True) for t, label in phrases] + [(label, t.encode().split(), False) for label, t in templates]


def grams(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, pos, hash) of every rolling gram of every text."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in slices(batch, texts, 2_000_000):
                at, first, hashes = [], [], []
                for i in range(a, b):
                    g = gram_hashes(word_hashes(words_of(texts[i])), k).view(np.int64)
                    for p in range(0, len(g), BLOCK):
                        at.append(i)
                        first.append(p)
                        hashes.append(g[p:p + BLOCK])
                if at:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int32)
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int32()),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes)))],
                        names=["doc_id", "key", "first", "hashes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, first int, hashes array<long>")
    return blocks.select("doc_id", "key", "first", F.posexplode("hashes").alias("i", "hash")).select(
        "doc_id", "key", (F.col("first") + F.col("i")).alias("pos"), "hash")


def votes(docs: DataFrame, known, k: int = GRAM) -> DataFrame:
    """(doc_id, key, template, diagonal, n, low, high): hits per diagonal."""
    rows = [(int(h), t, p) for t, (_, words, _) in enumerate(known)
            for p, h in enumerate(gram_hashes(word_hashes(words), k).view(np.int64).tolist())]
    places = docs.sparkSession.createDataFrame(rows, "hash long, template int, place int")
    hits = grams(docs, k).join(F.broadcast(places), "hash")
    return hits.groupBy("doc_id", "key", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def merge_diagonals(found: list[tuple[int, int, int]], size: int, slack: int = SLACK) -> list[tuple[int, int]]:
    """Text ranges (first gram, last gram) of (diagonal, low, high) that lie
    near each other in diagonal and text, by text position."""
    out: list[list[int]] = []
    for diagonal, low, high in sorted(found, key=lambda x: (x[1], x[2], x[0])):
        if out and abs(diagonal - out[-1][2]) <= slack and low <= out[-1][1] + size:
            out[-1][1:] = [max(out[-1][1], high), diagonal]
        else:
            out.append([low, high, diagonal])
    return [(a, b) for a, b, _ in out]


def verify(words: list[bytes], found: list[tuple[int, int, int, int]], known, k: int = GRAM):
    """(template, first word, last word, score) of each verified span, from
    (template, diagonal, low, high)."""
    by: dict[int, list] = {}
    for t, *rest in found:
        by.setdefault(t, []).append(tuple(rest))
    out, longer = [], []
    for t, diagonals in sorted(by.items()):
        _, template, exact = known[t]
        size = len(template)
        if exact:
            for d in sorted({x[0] for x in diagonals}):
                # one diagonal is one place of the whole phrase
                if d >= 0 and words[d:d + size] == template:
                    out.append((t, d, d + size - 1, 1.0))
            continue
        need, bag = COVERAGE * size, Counter(template)
        for low, high in merge_diagonals(diagonals, size):
            while low <= high:
                stop = min(high + k, low + 2 * size)  # a long run of hits holds several copies
                part = words[low:stop]
                # words in common, in any order, bound the subsequence
                if (bag & Counter(part)).total() >= need and (common := _common(template, part)) >= need:
                    longer.append((common, t, low, min(stop, low + size) - 1, common / size))
                low += size
    return out + sorted((t, a, b, score) for _, t, a, b, score in strongest(longer))


def strongest(spans: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Of (common words, template, first, last, score) that overlap by more
    than half of the shorter, the one with the most words in common."""
    out: list[tuple[int, int, int, int, float]] = []
    for x in sorted(spans, key=lambda x: (-x[0], -x[4], x[1], x[2])):
        if all(2 * (min(x[3], y[3]) - max(x[2], y[2]) + 1) <= min(x[3] - x[2], y[3] - y[2]) + 1 for y in out):
            out.append(x)
    return out


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """Per document: (doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans); spans are label:first:last:score."""
    store = Scratch(docs.sparkSession, "licenses")
    known = _templates(phrases, templates)
    if short := [" ".join(map(bytes.decode, words)) for _, words, _ in known if len(words) < k]:
        raise ValueError(f"of fewer than {k} words: {short}")
    found = store.write(votes(docs, known, k), "votes")
    per_doc = found.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.collect_list(F.struct("template", "diagonal", "low", "high")).alias("found"))
    if found.count() <= BROADCAST_ROWS:
        per_doc = F.broadcast(per_doc)  # at most BROADCAST_ROWS structs of 16 bytes; above, a shuffle join
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left").select("doc_id", "text", "found")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for t, hits in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = words_of(t)
                spans = verify(words, [tuple(h.values()) for h in hits], known, k) if hits else []
                base = [s for s in spans if known[s[0]][2]]
                values = (len(words), len(base), min((s[1] for s in base), default=None), max((s[1] for s in base), default=None),
                          ",".join(sorted({known[s[0]][0] for s in base})), ",".join(sorted({known[s[0]][0] for s in spans})),
                          max((s[3] for s in spans), default=0.0), ",".join(f"{known[s[0]][0]}:{s[1]}:{s[2]}:{s[3]:.3f}" for s in spans))
                for column, v in zip(out, values):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)],
                                             names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                                  "base_labels string, labels string, score double, spans string")
