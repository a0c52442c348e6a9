"""License scans with a positional rare-token index.

All documents are read once: how many have each word of the licences is counted, and the texts that have all words of some mandatory key
phrase go on. The templates' words are weighed by inverse document frequency. Of each template its rarest words are indexed
with their places in it. A file's rare licence words are looked up; each gives the place at which the template would have to start,
and the postings are intersected by those places, within a slack that leaves room for words put in or left out. Where enough of
them agree, the mandatory key phrase is verified word for word, and the template is held against the words around by the
heaviest common subsequence. Base phrases are templates of their own that have to stand word for word; wherever one stands, its rarest
word stands, so none is missed.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, cut

# The words of a text, the base phrases with their labels, and the templates (label, text, mandatory key phrase).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("lgpl", "licensed under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "permission to use copy modify and or distribute this software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program", "the terms of the gnu general public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "in no event will the authors be held liable for any damages"),
]
LOWER = {c: c + 32 for c in range(65, 91)}
MATCH = 0.8
#: So many of a template's rarest words are indexed; half of them have to agree on where it starts.
RARE = 6
_word = re.compile(WORD)


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").translate(LOWER))


def vocabulary(base: dict[str, str], templates: list[tuple[str, str, str]]) -> list[str]:
    return sorted({w for t in [*base, *[t[1] for t in templates]] for w in t.split()})


class Index:
    def __init__(self, n_docs: int, df: dict[str, int], base: dict[str, str] = BASE, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.idf = {w: math.log(1 + n_docs / (1 + df.get(w, 0))) for w in vocabulary(base, templates)}
        self.base: dict[str, list[tuple[list[str], str, int]]] = defaultdict(list)
        for phrase, label in sorted(base.items()):
            ws = phrase.split()
            at = min(range(len(ws)), key=lambda i: (-self.idf[ws[i]], ws[i], i))
            self.base[ws[at]].append((ws, label, at))
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.templates = []
        for t, (label, text, key) in enumerate(templates):
            ws = text.split()
            rare = sorted(range(len(ws)), key=lambda i: (-self.idf[ws[i]], ws[i], i))[:RARE]
            for i in rare:
                self.postings[ws[i]].append((t, i))
            self.templates.append((label, ws, key.split(), -(-len(rare) // 2), max(3, len(ws) // 4), sum(self.idf[w] for w in ws)))
        self.words = frozenset(self.base) | frozenset(self.postings)

    def common(self, a: list[str], b: list[str]) -> float:
        """Weight of the heaviest common subsequence."""
        row = [0.0] * (len(b) + 1)
        for x in a:
            if x in b:
                w, last = self.idf[x], 0.0
                for j, y in enumerate(b, 1):
                    up = row[j]
                    row[j] = last + w if x == y and last + w > up and last + w > row[j - 1] else max(up, row[j - 1])
                    last = up
        return row[-1]

    def starts(self, t: int, votes: list[tuple[int, int]]) -> Iterator[int]:
        """Places at which enough of a template's rare words agree that it starts; votes: (start, place), sorted."""
        _, _, _, need, slack, _ = self.templates[t]
        lo, counts, last = 0, defaultdict(int), None
        for start, place in votes:
            counts[place] += 1
            while votes[lo][0] < start - slack:
                p = votes[lo][1]
                counts[p] -= 1
                if not counts[p]:
                    del counts[p]
                lo += 1
            if len(counts) >= need and (last is None or votes[lo][0] > last):
                last = votes[lo][0]
                yield last

    def scan(self, ws: list[str], match: float = MATCH) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, their labels, all labels, and the best match's share of its template's weight."""
        if self.words.isdisjoint(ws):
            return [], set(), set(), 0.0
        found, base, labels, best = [], set(), set(), 0.0
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, w in enumerate(ws):
            if w in self.words:
                for phrase, label, place in self.base.get(w, ()):
                    if at >= place and ws[at - place : at - place + len(phrase)] == phrase:
                        found.append(at - place)
                        base.add(label)
                        best = 1.0
                for t, place in self.postings.get(w, ()):
                    votes[t].append((at - place, place))
        seen: dict[tuple, float] = {}
        for t, of in votes.items():
            label, template, key, _, slack, weight = self.templates[t]
            for start in self.starts(t, sorted(of)):
                region = tuple(ws[max(0, start - slack) : max(0, start + len(template) + 2 * slack)])
                if (share := seen.get((t, region))) is None:
                    stands = any(region[i : i + len(key)] == tuple(key) for i in range(len(region) - len(key) + 1) if region[i] == key[0])
                    share = seen[t, region] = min(1.0, self.common(template, list(region)) / weight) if stands else 0.0
                best = max(best, share)
                if share >= match:
                    labels.add(label)
        return found, base, base | labels, best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: list[tuple[str, str, str]] = TEMPLATES, match: float = MATCH) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, base_starts) per row of docs.

    Null or empty text: no words, no labels (empty strings), null first_word and last_word, score 0. A null id stays
    null. Repeated rows are scanned each. Empty table: no rows. Other columns are ignored. base_starts has the places of
    all base phrases. score: the largest share, by IDF, of a template's words that stand in its order where its key phrase
    stands; 1 where a base phrase stands.
    """
    vocab = vocabulary(base, templates)
    number = {w: i for i, w in enumerate(vocab)}
    known, keys = frozenset(vocab), [frozenset(k.split()) for k in [*base, *[t[2] for t in templates]]]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "has": pa.binary(), "text": pa.string()}
        for b in it:
            n, has, kept = [], [], []
            for t in b.column(1).to_pylist():
                ws = words(t)
                here = known.intersection(ws)
                bits = np.zeros(len(vocab), bool)
                bits[[number[w] for w in here]] = True
                n.append(len(ws))
                has.append(np.packbits(bits).tobytes())
                kept.append(t if any(k <= here for k in keys) else None)
            yield batch({"doc_id": b.column(0), "n_words": n, "has": has, "text": kept}, types)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocab), np.int64), 0
        for b in it:
            if len(b):
                rows = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(len(b), -1)
                total, n = total + np.unpackbits(rows, axis=1, count=len(vocab)).sum(0, dtype=np.int64), n + len(b)
        yield batch({"word": [-1, *range(len(vocab))], "n": [n, *total.tolist()]}, {"word": pa.int32(), "n": pa.int64()})

    first = cut(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(read, "doc_id long, n_words long, has binary, text string"))
    df = {r.word: r.n for r in first.select("has").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    index = Index(df.pop(-1, 0), {vocab[i]: n for i, n in df.items()}, base, templates)
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "base_starts": pa.list_(pa.int64())}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for i, n, t in zip(*[c.to_pylist() for c in b.columns]):
                starts, own, labels, score = index.scan(words(t), match) if t else ([], set(), set(), 0.0)
                starts.sort()
                out.append((i, n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(own)), ",".join(sorted(labels)), score, starts))
            yield batch(dict(zip(types, map(list, zip(*out)))) if out else {n: [] for n in types}, types)

    return first.select("doc_id", "n_words", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, base_starts array<long>")
