"""License scans by a positional index of rare licence words.

Templates are the paragraphs of licence wordings; their words are indexed by position. Of each template, its rarest
postings by IDF over all documents are looked up at every place of a text, as many as leave no alignment of enough words
without two votes. Votes for one template whose relative positions (place in the text less place in the template) lie
close together, though not equal, since words may be missing or added, mark a stretch of text; there the template is
aligned with gaps, and an alignment that covers enough of it, near all its mandatory key phrases, gives the label. Which
postings vote decides the work alone.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import ready, rows, texts

#: Phrases that alone tell a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, paragraph of the wording (words in lower case), mandatory key phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("permission is hereby granted free of charge",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license version 2 0",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", ("gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("must retain the above copyright notice",)),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", ("provided by the copyright holders and contributors as is",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("mozilla public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc", "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0 or send a letter to creative commons", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software released into the public domain",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("to alter it and redistribute it freely",)),
    ("boost", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license",)),
)
#: Share of a template's words that an alignment must be worth: each word in place counts 1, each word of the text
#: between two such words costs GAP.
COVER, GAP = 0.6, 0.25
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class Index:
    def __init__(self, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES, idf: dict[bytes, float] | None = None):
        self.templates = [(label, body.encode().split(), [k.encode().split() for k in keys]) for label, body, keys in templates]
        self.keys = [[f" {k} ".encode() for k in keys] for _, _, keys in templates]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        postings: dict[bytes, list] = defaultdict(list)
        for t, (_, body, _) in enumerate(self.templates):
            for i, w in enumerate(body):
                postings[w].append((t, i))
        #: Of the corpus where it is known, else of the templates.
        self.idf = idf or {w: math.log(len(self.templates) / len({t for t, _ in p})) + 1 / (1 + len(p)) for w, p in postings.items()}
        self.postings = defaultdict(list)
        #: Words of a text that an alignment worth COVER can span: its own, and as many others as its surplus pays for.
        self.reach = [len(body) + int((1 - COVER) * len(body) / GAP) for _, body, _ in self.templates]
        for t, (_, body, _) in enumerate(self.templates):
            # an alignment with `least` words in place misses len(body) - least postings: with two more, two of them vote
            least = next(m for m in range(len(body) + 1) if m >= COVER * len(body) - 1e-9)
            for i in sorted(range(len(body)), key=lambda i: (-self.idf.get(body[i], 9.0), i))[: len(body) - least + 2]:
                self.postings[body[i]].append((t, i))
        self.postings = dict(self.postings)
        #: A text without any of these can hold neither phrase nor key phrase: the rarest word of each.
        rare = lambda ws: max(ws, key=lambda w: (self.idf.get(w, 9.0), w))
        self.signs = sorted({rare(p) for p, _ in self.phrases} | {rare(k) for _, _, keys in self.templates for k in keys[:1]})

    def base(self, ws: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, last word, label) of every place where a phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            at = -1
            while True:
                try:
                    at = ws.index(phrase[0], at + 1)
                except ValueError:
                    break
                if ws[at : at + len(phrase)] == phrase:
                    out.append((at, at + len(phrase) - 1, label))
        return out

    def stretches(self, ws: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of the stretches of a text that two votes for a template lie close enough to share."""
        votes: dict[int, list] = defaultdict(list)
        for i, w in enumerate(ws):
            for t, p in self.postings.get(w, ()):
                votes[t].append((i, i - p))
        for t, found in votes.items():
            reach = self.reach[t]
            # relative positions of two words of one alignment differ by less than its reach, as do their places: they
            # are in one lane of relative positions, or in lanes next to each other
            lanes: dict[int, set] = defaultdict(set)
            for i, r in found:
                lanes[r // reach].add(i)
                lanes[r // reach - 1].add(i)
            close = sorted({(i, j) for at in lanes.values() for i, j in pairwise(sorted(at)) if j - i < reach})
            runs: list[list[int]] = []
            for i, j in close:
                a, b = max(0, i - reach), min(len(ws), j + reach)
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            yield from ((t, a, b) for a, b in runs)

    def aligned(self, ws: list[bytes]) -> dict[str, float]:
        """Label -> best share that an alignment of one of its templates is worth."""
        found: dict[str, float] = {}
        whole = b" ".join([b"", *ws, b""])
        held = [all(k in whole for k in keys) for keys in self.keys]  # nothing to align without them
        for t, a, b in self.stretches(ws) if any(held) else ():
            label, body, keys = self.templates[t]
            if not held[t]:
                continue
            worth = alignment(body, ws[a:b])
            ends = np.nonzero(worth >= COVER * len(body) - 1e-9)[0]
            for k in keys:
                last = np.array(phrase_ends(ws[max(0, a - 2) : b + 2], k), np.int64) + max(0, a - 2) - a
                if not len(last) or not len(ends):
                    ends = ends[:0]
                    break
                # an end counts if the phrase ends within the alignment's reach before it, or two words after it
                at = np.searchsorted(last, ends + 2, side="right") - 1
                ends = ends[(at >= 0) & (last[np.maximum(at, 0)] > ends - self.reach[t])]
            if len(ends):
                found[label] = max(found.get(label, 0.0), float(worth[ends].max()) / len(body))
        return found


def alignment(body: list[bytes], ws: list[bytes]) -> np.ndarray:
    """For each place of a text, the most that an alignment of the template ending there or before is worth, words since
    the last one in place being paid for: a row of the table for each word of the template, all places at once."""
    codes: dict[bytes, int] = {}
    text = np.array([codes.setdefault(w, len(codes)) for w in ws], np.int64)
    fee = GAP * np.arange(len(ws))
    row = np.zeros(len(ws))
    for w in body:
        before = np.append(0.0, row[:-1])
        row = np.maximum(row, np.where(text == codes.get(w, -1), before + 1, 0.0))
        row = np.maximum(np.maximum.accumulate(row + fee) - fee, 0.0)
    return row


def phrase_ends(ws: list[bytes], phrase: list[bytes]) -> list[int]:
    """Places of the last word wherever the phrase stands."""
    n = len(phrase)
    return [i + n - 1 for i in range(len(ws) - n + 1) if ws[i] == phrase[0] and ws[i : i + n] == phrase]


@lru_cache(maxsize=1)
def default_index() -> Index:
    return Index()


def scan(text: str | None, index: Index) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a whole text."""
    ws = words(text)
    raw = (text or "").encode("utf-8", "replace").lower()
    if not any(s in raw for s in index.signs):
        return len(ws), 0, None, None, "", "", 0.0
    base, found = index.base(ws), index.aligned(ws)
    labels = {b[2] for b in base}
    score = max([0.5 * bool(base), *found.values()])
    starts = [b[0] for b in base]
    return len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found.keys())), float(score)


def corpus_idf(docs: DataFrame) -> dict[bytes, float]:
    """IDF of every template word over all documents; as many rows as templates have words come back."""
    known = {w for _, body, _ in TEMPLATES for w in body.encode().split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, having = 0, Counter()
        for b in batches:
            total += b.num_rows
            for (t,) in rows(b, "text"):
                having.update(known.intersection(words(t)))
        yield pa.record_batch([pa.array([b"", *having]), pa.array([total, *having.values()])], ["word", "n"])

    found = {bytes(r["word"]): r["n"] for r in texts(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: math.log((1 + found.get(b"", 0)) / (1 + found.get(w, 0))) for w in known}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    first_word and last_word are the smallest and the largest start of a phrase; score is the best share, at least 0.5
    where a phrase stands. Null text counts as empty: no words, no labels, null places, score 0. Texts of any length are
    read whole, equal texts have equal rows, a label counts once however many wordings give it; ids may be null or
    repeated, an empty table gives none, and other columns are ignored.
    """
    ready(docs.sparkSession)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    idf = corpus_idf(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf=idf)
        for b in batches:
            columns = list(zip(*(scan(t, index) for (t,) in rows(b, "text")))) or [()] * 7
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
