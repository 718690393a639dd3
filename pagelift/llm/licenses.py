"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Words are runs of ASCII letters and digits, lowered, and of all characters from U+0080 on. Of the hashes of GRAM words in a row, winnowing keeps the
least of every WINNOW neighbours, in templates and texts alike, so that a common run of GRAM + WINNOW - 1 words always shares one; a notice, a template of fewer than NOTICE words, is
looked up by all hashes of as many words as any text that covers it enough must have in a row. A shared fingerprint names a template and a diagonal; the words around it are aligned
with the template inside a band around that diagonal. Reported are the spans whose matched words cover enough of the template and, of a notice, all its names and numbers, so that
versions and variants are told apart; and the next best template of the span. One pass without a shuffle; templates go out in blocks of bounded size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, saved, text_bytes
from .decontamination import BLOCK_BYTES, blocks
from .words import ALNUM, Words, chunks

GRAM, WINNOW = 3, 3
#: Words to either side of the diagonal that an alignment may stray, and the share of a template that must match.
BAND, COVERAGE = 8, 0.8
#: Words that make a template more than a notice, and what an index takes at most for each byte of a template.
NOTICE, INDEX_BYTES = 16, 64
#: Diagonals that are ruled out at once.
SPREAD = 64

# fixed values: notices by which texts name their license, and opening sentences
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "mit": "Released under the MIT License.",
    "bsd-name": "Released under the BSD License.",
    "isc-name": "Released under the ISC License.",
    "zlib-name": "Released under the Zlib License.",
    "unlicense-name": "Released under the Unlicense.",
    "epl-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "epl-1.0": "Licensed under the Eclipse Public License, version 1.0.",
    "mpl-1.1": "Licensed under the Mozilla Public License, version 1.1.",
    "mpl-2.0-name": "Licensed under the Mozilla Public License, version 2.0.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0": "Licensed under CC0 1.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
TEMPLATES |= {f"cc-{kind.lower()}-{version}": f"Licensed under CC {kind} {version}." for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")}
TEMPLATES |= {
    f"{short}-{version if '.' in version else version + '.0'}": f"This work is licensed under the {name}, version {version}."
    for short, name, versions in (("gpl", "GNU General Public License", "123"), ("lgpl", "GNU Lesser General Public License", ("2", "2.1", "3")), ("agpl", "GNU Affero General Public License", "3"))
    for version in versions
}


#: Template, start, end, matched words, words of the template, and of the next best template its name, matched words and words.
Found = tuple[str, int, int, int, int, str | None, int, int]


@cache
def known() -> tuple[tuple[str, bytes], ...]:
    """TEMPLATES, and whole license texts as ``whole-`` and the license's name."""
    texts = sorted(Path(__file__).with_name("license_texts").glob("*.txt"))
    return (*((k, v.encode()) for k, v in TEMPLATES.items()), *((f"whole-{p.stem}", p.read_bytes()) for p in texts))


def winnowed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints; no window reaches over the end of a text."""
    h, whole = w.windows(GRAM)
    if not len(h):
        return np.zeros(0, np.int64), h
    owner = np.searchsorted(w.first, np.arange(len(h)), side="right")
    masked = np.where(whole, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    least = np.zeros(len(h), bool)
    for i in range(WINNOW):  # h[j] is the least of the window that begins i before it
        low = masked.copy()
        for k in range(-i, WINNOW - i):
            moved = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
            a, z = max(0, -k), min(len(h), len(h) - k)
            if a < z:
                same = owner[a:z] == owner[a + k : z + k]
                moved[a:z] = np.where(same, masked[a + k : z + k], np.uint64(0xFFFFFFFFFFFFFFFF))
            low = np.minimum(low, moved)
        least |= low == masked
    at = np.flatnonzero(least & whole)
    return at, h[at]


def names_of(text: str) -> np.ndarray:
    """Which words of a notice are names or numbers: those with a digit, and those with a capital that begin no sentence."""
    found = [m for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]
    begins = [i == 0 or bool(re.search(r"[.:!?]\s+$", text[: m.start()])) for i, m in enumerate(found)]
    return np.array([any(c.isdigit() for c in m[0]) or any(c.isupper() for c in m[0]) and (not b or sum(map(str.isupper, m[0])) > 1) for m, b in zip(found, begins, strict=True)], bool)


class Index:
    """From a fingerprint to (template, place); the templates' words, and which of them must match."""

    def __init__(self, templates: list[tuple[str, bytes]], coverage: float = COVERAGE) -> None:
        self.names, self.words, self.required = [], [], []
        self.posted: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[tuple[int, int]]]] = {}  # by the words of a hash: templates that winnowing may pass over
        self.ids: dict[bytes, int] = {}
        for name, text in templates:
            w = Words([text], ALNUM)
            words = w.data.split()
            if not words:
                continue
            posted, (at, h) = self.posted, winnowed(w)
            if len(words) < NOTICE:
                unmatched = len(words) - math.ceil(coverage * len(words))
                gram = min(GRAM, -(-(len(words) - unmatched) // (unmatched + 1)))  # some run of so many words matches
                h = w.windows(gram)[0]
                posted, at = self.short.setdefault(gram, {}), np.arange(len(h))
            for i, x in zip(at.tolist(), h.tolist(), strict=True):
                posted.setdefault(x, []).append((len(self.names), i))
            self.names.append(name)
            self.required.append(np.flatnonzero(names_of(text.decode(errors="ignore"))) if len(words) < NOTICE else np.zeros(0, np.int64))
            self.words.append(np.array([self.ids.setdefault(x, len(self.ids)) for x in words]))
        self.tables = [(gram, p, np.array(sorted(p), np.uint64)) for gram, p in ((0, self.posted), *self.short.items())]

    def scan(self, texts: list[bytes], band: int, coverage: float) -> Iterator[list[Found]]:
        """For each text what is found in it: code points, by start; of spans that overlap, the one with most matched words, then the greatest coverage, the shortest, the least start and name, and
        the next of another template as its rival."""
        for _, part in chunks(texts):
            w = Words(part, ALNUM)
            seeds: dict[int, set[tuple[int, int]]] = {}
            for gram, posted, hashes in self.tables:
                if gram:
                    h, whole = w.windows(gram)
                    at = np.flatnonzero(whole)
                    h = h[at]
                else:
                    at, h = winnowed(w)
                hit = np.zeros(0, np.int64)
                if len(at) and len(hashes):
                    near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = np.flatnonzero(hashes[near] == h)
                for i in hit.tolist():
                    d = int(np.searchsorted(w.first, at[i], side="right")) - 1
                    for t, j in posted[int(h[i])]:
                        seeds.setdefault(d, set()).add((t, int(at[i]) - int(w.first[d]) - j))
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
            for d in range(len(part)):
                yield self.aligned(w, d, int(begin[d]), part[d], seeds.get(d, set()), band, coverage)

    def aligned(self, w: Words, d: int, begin: int, raw: bytes, seeds: set[tuple[int, int]], band: int, coverage: float) -> list[Found]:
        found: list[Found] = []
        a, z = int(w.first[d]), int(w.first[d + 1])
        said = np.array([self.ids.get(w.data[w.starts[i] : w.ends[i]], -1) for i in range(a, z)]) if seeds else None
        for t, of_one in groupby(sorted(seeds), lambda s: s[0]):
            template = self.words[t]
            for diagonal in likely(template, said, [x for _, x in of_one], band, coverage * len(template)):
                low, high = max(0, diagonal - band), min(z - a, diagonal + len(template) + band)
                pairs = banded(template, said[low:high], diagonal - low, band)
                if not pairs or len(pairs) < coverage * len(template) or not np.isin(self.required[t], [i for i, _ in pairs]).all():
                    continue
                x, y = int(w.starts[a + low + pairs[0][1]]) - begin, int(w.ends[a + low + pairs[-1][1]]) - begin
                start = len(raw[:x].decode(errors="ignore"))
                found.append((self.names[t], start, start + len(raw[x:y].decode(errors="ignore")), len(pairs), len(template), None, 0, 0))
        return best_of(found)


def best_of(found: list[Found]) -> list[Found]:
    out: list[Found] = []
    for f in sorted(found, key=lambda f: (-f[3], -f[3] / f[4], f[2] - f[1], f[1], f[0])):
        over = [k for k, o in enumerate(out) if f[1] < o[2] and f[2] > o[1]]
        if not over:
            out.append(f)
        for k in over:
            if out[k][5] is None and out[k][0] != f[0]:
                out[k] = (*out[k][:5], f[0], f[3], f[4])
    return sorted(out, key=lambda o: (o[1], o[0]))


def likely(template: np.ndarray, own: np.ndarray, diagonals: list[int], band: int, least: float) -> Iterator[int]:
    """Of ascending diagonals those on which ``least`` words could match: enough words of the template stand within ``band`` of
    their places, in any order. The places of several diagonals hold those of each, so that most are ruled out together."""
    at = 0
    while at < len(diagonals):
        end = at + 1
        while end < len(diagonals) and diagonals[end] <= diagonals[at] + SPREAD:
            end += 1
        groups = [diagonals[at:end]]
        while groups:
            group = groups.pop()
            hit = np.zeros(len(template), bool)
            for shift in range(group[0] - band, group[-1] + band + 1):
                a, z = max(0, -shift), min(len(template), len(own) - shift)
                if a < z:
                    hit[a:z] |= template[a:z] == own[a + shift : z + shift]
            if hit.any() and hit.sum() >= least:
                if len(group) == 1:
                    yield group[0]
                else:
                    groups += [group[len(group) // 2 :], group[: len(group) // 2]]
        at = end


def banded(template: np.ndarray, own: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """(place in ``template``, place in ``own``) of a longest common subsequence that stays ``band`` words from the diagonal, the tightest of these from its end."""
    rows, width = len(template), 2 * band + 1
    place = np.arange(rows)[:, None] + np.arange(width) + (diagonal - band)
    same = (place >= 0) & (place < len(own))
    same[same] = np.asarray(own)[place[same]] == np.repeat(np.asarray(template), same.sum(1))
    best = np.zeros((rows + 1, width + 1), np.int32)  # best[i, k]: of template[:i] and own[:i + diagonal - band + k]
    for i in range(1, rows + 1):
        np.maximum.accumulate(np.maximum(best[i - 1, 1:], (best[i - 1, :width] + 1) * same[i - 1]), out=best[i, :width])
    k = int(best[rows, :width].argmax())
    i, out = rows, []
    while i > 0 and best[i, k] > 0:
        j = i + diagonal - band + k
        if same[i - 1, k] and best[i, k] == best[i - 1, k] + 1:
            out.append((i - 1, j - 1))
            i -= 1
        elif best[i, k] == best[i - 1, k + 1]:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return out[::-1]


_KINDS = {"template": "string", "start": "long", "end": "long", "matched": "long", "words": "long", "rival": "string", "rival_matched": "long", "rival_words": "long"}


def scanned(docs: DataFrame, templates: DataFrame | None = None, *, band: int = BAND, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_licenses, licenses (array of template, start, end, matched, words, and of the next best template of the span rival, rival_matched, rival_words;
    code points, by start).

    ``templates`` has template_id and text; by default it is what ``known`` gives. Nulls: a null text has no words; templates with a null are passed over. Very long texts are scanned
    whole, and any number of licenses in them. Equal texts, and so repeated rows, have equal results; of equally good templates the one with the shortest span, then the first by name, is named. Empty tables: no rows, or no licenses. Other columns
    are not carried, so clashing names cannot disturb.
    """
    spark = docs.sparkSession
    given = blocks(templates, "template_id", "text", block_bytes, lambda text: INDEX_BYTES * len(text)) if templates is not None else iter([list(known())])
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    block, before = next(given, []), False
    while block is not None:
        shared = spark.sparkContext.broadcast(Index(block, coverage))

        def make(batches: Iterator[pa.RecordBatch], shared=shared, before=before) -> Iterator[dict]:
            for b in batches:
                found = list(shared.value.scan(text_bytes(b.column("text")), band, coverage))
                if before:
                    for own, *had in zip(found, *(b.column(k).to_pylist() for k in _KINDS), strict=True):
                        own += zip(*had, strict=True)
                        own[:] = best_of(own)
                yield {c: b.column(c) for c in ("doc_id", "text")} | {k: [[x[i] for x in own] for own in found] for i, k in enumerate(_KINDS)}

        out = map_batches(saved(out) if before else out, make, ", ".join(f"{k} array<{v}>" for k, v in _KINDS.items()), ("doc_id", "text"))
        block, before = next(given, None), True
    return out.select("doc_id", F.size("template").cast("long").alias("n_licenses"), F.arrays_zip(*_KINDS).alias("licenses"))
