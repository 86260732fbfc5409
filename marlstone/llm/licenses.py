"""Licence scans by a positional index of rare words.

Each template is a licence notice or the text of a licence, with mandatory key phrases at fixed word positions. The
licence words are weighted by their inverse document frequency over the whole corpus. A phrase can only stand in
a file that has all its words, so of those the file's highest-IDF one is its rarest word, whatever the file:
that word's posting is (template, phrase, position). In a file the posted words are looked up; the
places that they propose are intersected by relative position, and where all phrases of a template have one, the
phrases are verified word by word.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import table

#: Words by which a phrase may stand away from its place relative to the first (names, years).
SLACK = 12

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_MIT = _GRANT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."

#: Licence, notice, mandatory phrases (parts of the notice).
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("licensed under the apache license", "version 2.0")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", ("apache license version 2.0 january 2004",)),
    ("MIT", "Released under the MIT License", ("under the mit license",)),
    ("MIT", "Licensed under the MIT license", ("licensed under the mit license",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("terms of the gnu general public license", "published by the free software foundation", "version 3 of the license")),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("terms of the gnu general public license", "published by the free software foundation", "version 2 of the license")),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu lesser general public license", "version 3 of the license")),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license", "version 3 of the license")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder", ("redistribution and use in source and binary forms with or without modification are permitted",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("subject to the terms of the mozilla public license", "v 2.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("under cc by nc 4.0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("under cc by sa 4.0",)),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("under cc by 4.0",)),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal", ("cc0 1.0 universal",)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("MIT", _MIT, ("permission is hereby granted free of charge to any person obtaining a copy", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied")),
    ("ISC", _ISC, ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies", "the author disclaims all warranties with regard to this software")),
    ("BSD-2-Clause", _BSD.format(third=""), ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is")),
    ("BSD-3-Clause", _BSD.format(third=_THIRD), ("redistribution and use in source and binary forms with or without modification are permitted", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "this software is provided by the copyright holders and contributors as is")),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("in no event will the authors be held liable for any damages arising from the use of this software", "the origin of this software must not be misrepresented", "this notice may not be removed or altered from any source distribution")),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license version 1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation")),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE", ("with or without fee is hereby granted the software is provided as is and the author disclaims all warranties",)),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("made available under the terms of the eclipse public license 2.0",)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "distributed on an as is basis without warranties or conditions of any kind")),
)


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in W.WORD.finditer(text)]


class Index:
    """Templates as word numbers, and postings from each phrase's rarest word."""

    def __init__(self, templates=TEMPLATES, idf: dict[str, float] | None = None):
        self.names = [t[0] for t in templates]
        self.phrases: list[list[tuple[int, list[str]]]] = []
        for name, notice, phrases in templates:
            body, found = words_of(notice), []
            for phrase in map(words_of, phrases):
                at = next((k for k in range(len(body)) if body[k : k + len(phrase)] == phrase), None)
                if at is None:
                    raise ValueError(f"{name}: {' '.join(phrase)!r} is not in the notice")
                found.append((at, phrase))
            self.phrases.append(sorted(found))
        self.words = sorted({w for t in self.phrases for _, p in t for w in p})
        h = np.concatenate([W.span_hash(b, *W.split(b)) for b in (np.frombuffer(w.encode(), np.uint8) for w in self.words)])
        order = np.argsort(h)
        self.hashes, self.number = h[order], order.astype(np.int64)
        idf = idf or {}
        self.postings: dict[int, list[tuple[int, int, int]]] = {}
        lookup = {w: k for k, w in enumerate(self.words)}
        self.coded = [[(at, [lookup[w] for w in p]) for at, p in t] for t in self.phrases]
        for t, phrases in enumerate(self.coded):
            for k, (_, p) in enumerate(phrases):
                rare = max(range(len(p)), key=lambda i: (idf.get(self.words[p[i]], math.inf), -i))
                self.postings.setdefault(p[rare], []).append((t, k, rare))
        self.anchor = np.zeros(len(self.words) + 1, bool)
        self.anchor[list(self.postings)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word hash; len(words) for words in no phrase."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], len(self.words))

    def find(self, seq: np.ndarray) -> list[tuple[str, int, int]]:
        """(licence, first word, end word) of every template in one text's word numbers."""
        proposed: dict[int, list[list[int]]] = {}
        for at in np.flatnonzero(self.anchor[seq]).tolist():
            for t, k, rare in self.postings[int(seq[at])]:
                if 0 <= at - rare <= len(seq) - len(self.coded[t][k][1]):
                    proposed.setdefault(t, [[] for _ in self.coded[t]])[k].append(at - rare)
        found = set()
        for t, places in proposed.items():
            phrases = self.coded[t]
            if not self.placed(t, places):
                continue
            sure = [[s for s in mine if seq[s : s + len(p)].tolist() == p] for mine, (_, p) in zip(places, phrases)]
            found.update((self.names[t], s, e) for s, e in self.placed(t, sure))
        return sorted(f for f in found if not any(g != f and g[1] <= f[1] and f[2] <= g[2] and (g[2] - g[1] > f[2] - f[1]) for g in found))

    def placed(self, t: int, places: list[list[int]]) -> list[tuple[int, int]]:
        """(first word, end word) of each place of the template's first phrase near which, ``SLACK`` words at most from
        where they belong, all others have a place (of several the nearest, then the first); ``places`` are in order."""
        phrases = self.coded[t]
        out = []
        for first in places[0]:
            end = first + len(phrases[0][1])
            for (at, p), mine in zip(phrases[1:], places[1:]):
                want = first + at - phrases[0][0]
                near = mine[bisect.bisect_left(mine, want - SLACK) : bisect.bisect_right(mine, want + SLACK)]
                if not near:
                    break
                end = max(end, min(near, key=lambda s: (abs(s - want), s)) + len(p))
            else:
                out.append((first, end))
        return out


def _numbered(index: Index, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, buf, off in W.blocks(column, lower=True):
        s, e = W.split(buf)
        yield lo, hi, index.numbers(W.span_hash(buf, s, e)), W.rows_of(off, s)


def document_frequencies(docs: DataFrame, index: Index) -> dict[str, int]:
    """In how many rows each licence word stands, over all of ``docs``, and under '' the number of rows."""
    size = len(index.words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            rows += len(batch)
            for lo, hi, num, cut in _numbered(index, batch.column(0)):
                kept = np.flatnonzero(num < size - 1)
                row = np.searchsorted(cut, kept, side="right") - 1
                df += np.bincount(np.unique(row * size + num[kept]) % size, minlength=size)
        df[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(df)], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {(index.words + [""])[r["word"]]: r["n"] for r in counts}


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, license, start, end of every licence notice in ``docs``; start and end are character offsets.

    Words are compared lower-cased, punctuation and white space do not matter. A null or empty text has
    no notice; null doc_ids are reported as such; repeated rows each report. Notices are reported as
    often as they stand in a text; one within a longer one is not; of licences whose notices have the same words
    each is reported. Texts of any length are scanned whole. Further columns are ignored. With no template or no
    document the result is empty.
    """
    spark = docs.sparkSession
    kinds = "doc_id long, license string, start int, end int"
    if not templates:
        return spark.createDataFrame([], kinds)
    n = document_frequencies(docs, Index(templates))
    total = n.pop("", 0)
    index = Index(templates, {w: math.log((total + 1) / (df + 1)) for w, df in n.items()})
    shared = spark.sparkContext.broadcast(index)  # as large as the templates, not the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for lo, hi, num, cut in _numbered(index, batch.column(1)):
                hit = np.unique(np.searchsorted(cut, np.flatnonzero(index.anchor[num]), side="right") - 1)
                for r in hit.tolist():
                    found = index.find(num[cut[r] : cut[r + 1]])
                    if found:
                        chars = W.word_spans(batch.column(1)[lo + r].as_py())
                        rows += [(batch.column(0)[lo + r].as_py(), name, chars[s][0], chars[e - 1][1]) for name, s, e in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "license", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licence notices in all documents."""
    return scan(table(spark, sf_dir, "documents"))
