"""License scans by conditional compression.

A candidate block is a paragraph that speaks of licensing, taken whole, without comment marks and with its lines joined, as
notices are wrapped at any width. Its words are compressed in windows as long as a notice, alone and with the words of each
template as a raw zstandard dictionary. In every window the templates are ranked by the bytes that the dictionary saves, and
those that save enough for a notice are confirmed by the exact differences in wording: the words of the template that a notice
lacks or changes must be few, and none of them may be a word that tells licenses apart (a version number, NC, ND, SA and the
like). Of the confirmed notices of one license in one place the one that saves most counts. Each is weighed by itself, by the
share that its template saves of its text, whatever else the block holds.

Windows are no longer than a notice can be, with few words to spare, as a short notice saves next to nothing of a long window
or one of rare words. Words of no template of the size are marks in them, as they say nothing of its wording.

Defined results. Null or empty text: no blocks, no license. Paragraphs of any length are whole blocks. Repeated notices count each
time. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

TRIGGER = re.compile(r"licen[cs]|copyright|permission is hereby|redistribution and use|without warranty|spdx|public domain|all rights reserved", re.I)
# One word of each trigger, as the others may stand on the next line.
HINTS = ("licen", "copyright", "hereby", "redistribution", "warranty", "spdx", "public", "reserved")
LEADER = re.compile(r"(?:(?://+!?|/\*+!?|\(\*+|\*+[/)]?|#+|;+|--+|%+|!+|<!--|>+|(?:dnl|rem)\b)\s*)+", re.I)
# A window with a notice saves at least LEAST_SAVED of what its template saves of itself: a search for windows that save little,
# over all templates, places of the changes and words around them, found no share below 0.38.
LEVEL, MAX_CHANGED, LEAST_SAVED, MARK = 6, 0.12, 0.25, "?"

# Wordings of license notices as published by their stewards, and short forms in common use.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-short": "Released under the BSD License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, dedicated to the public domain.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-long": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TELLING = {"nc", "nd", "sa", "by", "cc", "cc0", "mit", "bsd", "isc", "apache", "gnu", "lesser", "affero", "mozilla", "boost", "general", "1", "2", "3", "4", "0"}


def template_license(name: str) -> str:
    return re.sub(r"-(short|long)$", "", name)


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bare(line: str) -> str:
    """The line without comment marks, white space as single spaces."""
    line = line.strip()
    if lead := LEADER.match(line):
        line = line[lead.end() :]
    for mark in ("*/", "*)", "-->"):
        line = line.removesuffix(mark)
    return " ".join(line.split())


def blocks(text: str) -> list[str]:
    """Paragraphs with a trigger, each as one line; lines of comment marks alone part paragraphs as empty ones do."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if line := bare(line):
            run.append(line)
        elif run:
            block = " ".join(run)
            if TRIGGER.search(block):
                out.append(block)
            run = []
    return out


class Scanner:
    """Ranks templates in a block and confirms its notices; compressors are made once per worker."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        import zstandard

        self.words = {k: words(v) for k, v in sorted(templates.items())}
        self.most = {k: int(MAX_CHANGED * len(w)) for k, w in self.words.items()}
        self.vocabulary = {x: i for i, x in enumerate(sorted({x for w in self.words.values() for x in w}))}
        self.sizes: dict[int, list[str]] = {}
        self.owned: dict[int, np.ndarray] = {}  # by size of template, whether it has the word of that number; the last is for words of none
        for k, w in self.words.items():
            self.sizes.setdefault(len(w), []).append(k)
            self.owned.setdefault(len(w), np.zeros(len(self.vocabulary) + 1, dtype=bool))[[self.vocabulary[x] for x in w]] = True
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        made = lambda v: zstandard.ZstdCompressionDict(v.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given = lambda v: zstandard.ZstdCompressor(level=LEVEL, dict_data=made(v), write_content_size=False, write_dict_id=False)
        self.given = {k: given(" ".join(w)) for k, w in self.words.items()}
        self.texts = {k: given(v) for k, v in sorted(templates.items())}
        self.least = {k: LEAST_SAVED * self.saved(k, w) for k, w in self.words.items()}
        self.ranked = functools.lru_cache(1 << 16)(self._ranked)
        self.known: dict[str, list] = {}

    def saving(self, name: str, notice: str) -> float:
        raw = notice.encode("utf-8", "replace")
        return 1 - len(self.texts[name].compress(raw)) / len(self.alone.compress(raw))

    def saved(self, name: str, have: list[str]) -> int:
        """Bytes that the template saves of words."""
        raw = " ".join(have).encode()
        return len(self.alone.compress(raw)) - len(self.given[name].compress(raw))

    def _ranked(self, n: int, window: str) -> list[str]:
        """Templates of n words by the bytes that they save of a window, without those that save too little for a notice."""
        raw = window.encode()
        alone = len(self.alone.compress(raw))
        saved = sorted((len(self.given[k].compress(raw)) - alone, k) for k in self.sizes[n])
        return [k for x, k in saved if -x >= self.least[k]]

    def candidates(self, have: list[str]) -> dict[str, list[list[int]]]:
        """By template, the windows of a block that it saves enough of, overlaps merged.

        Every part as long as a notice lies whole in a window; one with too few words of the templates of a size cannot hold a
        notice of theirs.
        """
        numbers = np.array([self.vocabulary.get(w, -1) for w in have], dtype=np.int64)
        out: dict[str, list[list[int]]] = {}
        for n, names in self.sizes.items():
            most = self.most[names[0]]
            step = max(1, most)
            begins = np.arange(0, len(have) - n + most + 1, step)
            ends = np.minimum(begins + n + most + step - 1, len(have))
            own = self.owned[n][numbers]
            total = np.concatenate(([0], np.cumsum(own)))
            full = total[ends] - total[begins] >= n - most
            if not full.any():
                continue
            marked = [w if x else MARK for w, x in zip(have, own.tolist(), strict=True)]
            for lo, hi in zip(begins[full].tolist(), ends[full].tolist(), strict=True):
                for name in self.ranked(n, " ".join(marked[lo:hi])):
                    near = out.setdefault(name, [])
                    if near and lo <= near[-1][1]:
                        near[-1][1] = hi
                    else:
                        near.append([lo, hi])
        return out

    def places(self, name: str, have: list[str], near: list[list[int]]) -> list[tuple[int, int, int]]:
        """(first word, end, differing words) of every notice with the template's wording in parts of a block."""
        near, out = list(near), []
        while near:
            lo, hi = near.pop()
            found = [(lo + s, lo + e, changed) for s, e, changed in self._aligned(self.words[name], self.most[name], have[lo:hi])]
            out += found
            if found:
                near += [[a, b] for a, b in zip([lo, *(e for _, e, _ in found)], [*(s for s, *_ in found), hi], strict=True)]
        return sorted(out)

    @staticmethod
    def _aligned(want: list[str], most: int, have: list[str]) -> list[tuple[int, int, int]]:
        """Parts of have that lack or put in at most so many words, none of them telling; the best of those that overlap.

        Parts without a difference come first, by themselves.
        """
        if (Counter(want) & Counter(have)).total() < len(want) - most:
            return []
        out, k = [], 0
        joined, whole = f" {' '.join(have)} ", f" {' '.join(want)} "
        while (k := joined.find(whole, k)) >= 0:
            s = joined.count(" ", 0, k)
            out.append((s, s + len(want), 0))
            k += len(whole) - 1
        if out or not most:
            return out
        cost = [most + 1 if w in TELLING else 1 for w in want]
        row = [(0, 0)]
        for c in cost:
            row.append((row[-1][0] + c, 0))
        ends = []
        for j, x in enumerate(have):
            more = most + 1 if x in TELLING else 1
            new = [(0, -j - 1)]  # starts are negative: of equal parts the one that starts last
            for i, w in enumerate(want):
                here = min((row[i + 1][0] + more, row[i + 1][1]), (new[i][0] + cost[i], new[i][1]))
                new.append(min(here, row[i]) if w == x else here)
            row = new
            if row[-1][0] <= most:
                ends.append((row[-1][0], j + 1, -row[-1][1]))
        own = set()
        for changed, e, s in sorted(ends):
            if own.isdisjoint(range(s, e)):
                own.update(range(s, e))
                out.append((s, e, changed))
        return sorted(out)

    def scan(self, block: str) -> list[tuple[str, float, int]]:
        """(license, saving, differing words) of every notice that a block holds."""
        if block in self.known:
            return self.known[block]
        low = block.lower()
        text = block if len(low) == len(block) else low
        spans = [m.span() for m in re.finditer(r"[a-z0-9]+", low)]
        have = [low[s:e] for s, e in spans]
        # Each notice is weighed by itself, however long the rest of the block is.
        found = []
        for name, near in self.candidates(have).items():
            for s, e, changed in self.places(name, have, near):
                a, b = spans[s][0], spans[e - 1][1]
                while a and not text[a - 1].isspace() and not text[a - 1].isalnum():
                    a -= 1
                while b < len(text) and not text[b].isspace() and not text[b].isalnum():
                    b += 1
                found.append((-self.saved(name, have[s:e]), name, s, e, changed, self.saving(name, text[a:b])))
        # Templates of one license in one place are one notice: the one that saves most counts.
        out, own = [], {}
        for _, name, s, e, changed, saving in sorted(found):
            held = own.setdefault(template_license(name), set())
            if held.isdisjoint(range(s, e)):
                held.update(range(s, e))
                out.append((template_license(name), saving, changed))
        if len(self.known) < 4096 and len(block) < 2048:
            self.known[block] = out
        return out


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_blocks, n_confirmed, licenses (sorted, comma-joined), best_saving and n_changed_words of the confirmed ones."""

    def scanned(batches):
        import pyarrow as pa

        scanner = Scanner()
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                own = blocks(x or "")
                hits = [h for block in own for h in scanner.scan(block)]
                rows.append((len(own), len(hits), ",".join(sorted({h[0] for h in hits})), max((h[1] for h in hits), default=0.0), sum(h[2] for h in hits)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_blocks", "n_confirmed", "licenses", "best_saving", "n_changed_words"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(scanned, "doc_id long, n_blocks long, n_confirmed long, licenses string, best_saving double, n_changed_words long")
