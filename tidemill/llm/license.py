"""Licence notices by a positional index of rare words.

Templates are notices with mandatory key phrases.  Document frequencies of all template words are counted over all documents.  A file holds a
template if at least `coverage` of the template's words stand in the file in order, each within `slack` positions of one alignment, and all
of its key phrases stand there word for word.  By the pigeonhole principle such a file holds at least one of the template's
n - ceil(coverage n) + 1 rarest words on that alignment: only those words are indexed, with their positions in the template.
Every file looks up all of its words in that index; its hits vote for (template, file position - template position); alignments with
a vote within `slack` are verified over the whole notice.

The notices: the published headers of files of the GNU licences, SPDX tags (of an expression, its first licence), the names of Creative Commons
licences with hyphens as published, and one sentence or phrase each of the others.

Cases: null or empty texts hold no notice; a notice that occurs several times is reported once for each place;
repeated rows are each scanned; of templates that both match at one place both are reported; extra columns are ignored; with an empty
table every word is equally rare and there is no row; texts of any length are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ident, lean
from .words import pieces, words

COVERAGE, SLACK = 0.8, 4
BSD_WORDS = 250  #: how far the last clause of BSD-3-Clause is from its beginning at most

#: (licence, notice, mandatory phrases)
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("MIT", "Released under the MIT License", ["mit license"]),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3", ["gnu lesser general public license version 3"]),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license version 3"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0", ["cc0 1 0"]),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    # the published file headers, up to their versions, with "or any later version" and without
    ("GPL-3.0", "is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License", ["gnu general public license as published by the free software foundation", "either version 3 of the license"]),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", ["gnu general public license as published by the free software foundation version 3"]),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation", ["gnu general public license version 3 as published by"]),
    ("GPL-2.0", "is free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu general public license as published by the free software foundation", "either version 2 of the license"]),
    ("GPL-2.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2", ["gnu general public license as published by the free software foundation version 2"]),
    ("GPL-2.0", "redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ["gnu general public license version 2 as published by"]),
    ("LGPL-3.0", "is free software you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License", ["gnu lesser general public license as published by the free software foundation", "either version 3 of the license"]),
    ("LGPL-3.0", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3", ["gnu lesser general public license as published by the free software foundation version 3"]),
    ("LGPL-3.0", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation", ["gnu lesser general public license version 3 as published by"]),
    ("LGPL-2.1", "is free software you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ["gnu lesser general public license as published by the free software foundation", "either version 2 1 of the license"]),
    ("LGPL-2.1", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1", ["gnu lesser general public license as published by the free software foundation version 2 1"]),
    ("LGPL-2.1", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation", ["gnu lesser general public license version 2 1 as published by"]),
    ("LGPL-2.0", "is free software you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", ["gnu library general public license as published by the free software foundation", "either version 2 of the license"]),
    ("LGPL-2.0", "redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, version 2", ["gnu library general public license as published by the free software foundation version 2"]),
    ("LGPL-2.0", "redistribute it and/or modify it under the terms of the GNU Library General Public License version 2 as published by the Free Software Foundation", ["gnu library general public license version 2 as published by"]),
    ("AGPL-3.0", "is free software you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License", ["gnu affero general public license as published by the free software foundation", "either version 3 of the license"]),
    ("AGPL-3.0", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3", ["gnu affero general public license as published by the free software foundation version 3"]),
    ("AGPL-3.0", "redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation", ["gnu affero general public license version 3 as published by"]),
    # Creative Commons by their long names
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", ["creative commons attribution noncommercial sharealike 4 0"]),
    ("CC-BY-NC-SA-3.0", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0", ["creative commons attribution noncommercial sharealike 3 0"]),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", ["creative commons attribution noncommercial noderivatives 4 0"]),
    ("CC-BY-NC-ND-3.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 3.0", ["creative commons attribution noncommercial noderivatives 3 0"]),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", ["creative commons attribution noncommercial 4 0"]),
    ("CC-BY-NC-3.0", "Creative Commons Attribution-NonCommercial 3.0", ["creative commons attribution noncommercial 3 0"]),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", ["creative commons attribution sharealike 4 0"]),
    ("CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0", ["creative commons attribution sharealike 3 0"]),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0", ["creative commons attribution noderivatives 4 0"]),
    ("CC-BY-ND-3.0", "Creative Commons Attribution-NoDerivatives 3.0", ["creative commons attribution noderivatives 3 0"]),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0", ["creative commons attribution 4 0"]),
    ("CC-BY-3.0", "Creative Commons Attribution 3.0", ["creative commons attribution 3 0"]),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal", ["creative commons zero v1 0 universal"]),
    ("CC0-1.0", "CC0 1.0 Universal", ["cc0 1 0 universal"]),
    # the clause that BSD-2-Clause lacks: where it follows the common beginning, both are one notice
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without written permission", ["all rights reserved"]),
]

#: SPDX tags: the words of the tag itself, all in a row
_SPDX = (
    "MIT Apache-2.0 GPL-3.0 GPL-2.0 LGPL-3.0 LGPL-2.1 LGPL-2.0 AGPL-3.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 "
    "CC0-1.0 BSD-2-Clause BSD-3-Clause MPL-2.0 ISC Unlicense"
).split()  # "-only", "-or-later" and "+" may follow
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}", ["spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")]) for x in _SPDX]


@dataclass
class Templates:
    names: list[str]
    hashes: list[np.ndarray]
    phrases: list[list[np.ndarray]]

    @property
    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate(self.hashes))


def compiled(templates: list[tuple[str, str, list[str]]] | None = None) -> Templates:
    rows = TEMPLATES if templates is None else templates
    one = lambda t: words(pa.array([t], pa.large_string())).hash
    return Templates([n for n, _, _ in rows], [one(t) for _, t, _ in rows], [[one(p) for p in ps] for _, _, ps in rows])


def _hits(h: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that are in the sorted keys, and which key each is."""
    at = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    same = keys[k] == h[at]
    return at[same], k[same]


def _bits(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 16, bool)
    bits[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    return bits


def frequencies(docs: DataFrame, keys: np.ndarray, text_col: str = "text") -> np.ndarray:
    """In how many documents each of the words stands; over all documents."""
    bits = _bits(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for b in pieces(batch, "text"):
                w = words(b.column(0))
                at, k = _hits(w.hash, keys, bits)
                pair = np.unique(w.row[at] * len(keys) + k)
                total += np.bincount(pair % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total)], ["k", "n"])

    got = docs.select(ident(text_col).cast("string").alias("text")).mapInArrow(lean(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(keys), np.int64)
    for r in got:  # as many rows as the templates have words
        df[r.k] = r.n
    return df


@dataclass
class Index:
    """Postings of the rarest words: template and position, by sorted key."""

    keys: np.ndarray
    begin: np.ndarray
    template: np.ndarray
    pos: np.ndarray
    bits: np.ndarray


def index(t: Templates, keys: np.ndarray, df: np.ndarray, coverage: float = COVERAGE) -> Index:
    post = []
    for i, h in enumerate(t.hashes):
        n = len(h)
        rare = n - math.ceil(coverage * n) + 1
        order = sorted(range(n), key=lambda p: (df[np.searchsorted(keys, h[p])], p))  # highest IDF first
        post += [(int(h[p]), i, p) for p in order[:rare]]
    post.sort()
    h = np.array([p[0] for p in post], np.uint64)
    own, begin = np.unique(h, return_index=True)
    return Index(own, np.append(begin, len(h)), np.array([p[1] for p in post]), np.array([p[2] for p in post]), _bits(own))


def _aligned(template: np.ndarray, own: np.ndarray, start: int, slack: int) -> tuple[int, int, int]:
    """Most words of the template that stand in order, each within slack of start + position; and the span they take."""
    by: dict[int, list[int]] = {}
    for p in range(max(0, start - slack), min(len(own), start + len(template) + slack)):
        by.setdefault(int(own[p]), []).append(p)
    best: list[tuple[int, int, int]] = []  # (file position, length of the chain, its first position)
    top = (0, start, start)
    for i, h in enumerate(template):
        new = []
        for p in by.get(int(h), ()):
            if abs(p - start - i) <= slack:
                n, first = max(((n, f) for q, n, f in best if q < p), key=lambda x: (x[0], x[1]), default=(0, p))
                new.append((p, n + 1, first if n else p))
                if (n + 1, first if n else p) > (top[0], top[1]):
                    top = (n + 1, first if n else p, p + 1)
        best += new
    return top


def _has(own: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(own) - len(phrase) + 1
    if n <= 0:
        return False
    ok = np.ones(n, bool)
    for i, h in enumerate(phrase):
        ok &= own[i : i + n] == h
    return bool(ok.any())


def find(t: Templates, ix: Index, column: pa.Array, coverage: float = COVERAGE, slack: int = SLACK) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first word, past word, coverage) of every notice."""
    w = words(column)
    at, k = _hits(w.hash, ix.keys, ix.bits)
    if not len(at):
        return []
    count = ix.begin[k + 1] - ix.begin[k]
    post = np.repeat(ix.begin[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
    at = np.repeat(at, count)
    first = w.first
    tried = sorted({(int(w.row[a]), int(i), int(a - first[w.row[a]] - p)) for a, i, p in zip(at, ix.template[post], ix.pos[post])})
    # a vote may be up to slack off the alignment; within twice that it must find enough words
    near_votes: set[tuple[int, int, int]] = set()
    for row, i, start in tried:
        if _aligned(t.hashes[i], w.hash[first[row] : first[row + 1]], start, 2 * slack)[0] >= math.ceil(coverage * len(t.hashes[i])):
            near_votes.update((row, i, s) for s in range(start - slack, start + slack + 1))
    out: list[tuple[int, int, int, int, float]] = []
    for row, i, start in sorted(near_votes):
        own = w.hash[first[row] : first[row + 1]]
        n, a, z = _aligned(t.hashes[i], own, start, slack)
        if n < math.ceil(coverage * len(t.hashes[i])):
            continue
        near = own[max(0, a - slack) : z + slack]
        if not all(_has(near, p) for p in t.phrases[i]):
            continue
        found = (row, i, a, z, n / len(t.hashes[i]))
        if out and out[-1][:2] == found[:2] and a < out[-1][3]:  # the same notice by another vote: the better stays
            if found[4] > out[-1][4]:
                out[-1] = found
        else:
            out.append(found)
    return _one_bsd(t, out)


def _one_bsd(t: Templates, found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """BSD-3-Clause begins as BSD-2-Clause does: where its last clause follows, they are one notice of BSD-3-Clause."""
    out: list[tuple[int, int, int, int, float]] = []
    begun: tuple | None = None
    for x in sorted(found, key=lambda x: (x[0], x[2])):
        name = t.names[x[1]]
        if name == "BSD-2-Clause":
            begun = x
        elif name == "BSD-3-Clause" and begun and begun[0] == x[0] and x[2] - begun[3] <= BSD_WORDS:
            out.remove(begun)
            x, begun = (x[0], x[1], begun[2], x[3], min(begun[4], x[4])), None
        out.append(x)
    return out


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list | None = None, coverage: float = COVERAGE, slack: int = SLACK) -> DataFrame:
    """(doc_id, license, first, past, coverage): each licence notice and the words [first, past) it takes."""
    t = compiled(templates)
    keys = t.vocabulary
    ix = index(t, keys, frequencies(docs, keys, text_col), coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                got = find(t, ix, b.column(1), coverage, slack)
                if got:
                    r, i, a, z, c = zip(*got)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array([t.names[x] for x in i]), pa.array(a, pa.int32()), pa.array(z, pa.int32()), pa.array(c, pa.float64())], ["doc_id", "license", "first", "past", "coverage"])

    narrow = docs.select(ident(id_col).cast("long").alias("id"), ident(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), "doc_id long, license string, first int, past int, coverage double")
