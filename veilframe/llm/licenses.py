"""License notices by conditional compression.

Blocks of words around cue words are compressed by themselves and once with each
template as a zstandard raw dictionary. Templates are ranked by the bytes that they
save, and those that save at least ``close`` of what they save on their own text are
winners there. Only winners are compared word by word: at least ``share`` of the
template's words must be there in order, with no more words put in than the template
has, and the words that tell licenses apart must agree exactly:

* names and version numbers of the template must be in the text;
* words that make another license of it or turn it round (Affero, Lesser, NC, not)
  must be in both or neither, "not" also directly before.

Of winners that agree and overlap, the one that explains most words stands; its words
are taken out and the rest is ranked again, until nothing is confirmed. A notice without
a version has the name of its family (GPL, LGPL, AGPL, BSD).

Short, middle and long templates have blocks of their own: four times the longest
template of the class, each beginning in the middle of the one before, so that every
notice lies whole in a block, and a block is never much longer than what it is compared
with. Words are taken in lower case without the signs between them, so line ends, comment
signs and case play no part.

One row per notice, with the rest of the sentences or lines that it lies in, up to the
next notice; neighbouring sentences with a cue in which no notice lies are one row
without a license, however many. Missing and extra words say how a row differs from its
template. Everything happens per row; Spark reads, filters by cue and spreads the rows.

Defined results: null and empty texts have no rows; repeated rows each yield theirs, null
ids too; of templates that explain equally many words the one with fewer words put in
wins and then the first by name; of several identifiers in one SPDX tag the first is
reported and the others are extra words; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import words

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:"
)
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission. "
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction"
)
# Notices as their licenses word them.
TEMPLATES: Mapping[str, str] = {
    "AGPL": "This work is licensed under the GNU Affero General Public License.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "All rights reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": _BSD,
    "BSD-2-Clause": _BSD + _BSD_TWO + _AS_IS,
    "BSD-3-Clause": _BSD + _BSD_TWO + _BSD_THREE + _AS_IS,
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0"
    ),
    "GPL": "This work is licensed under the GNU General Public License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-or-later notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies."
    ),
    "LGPL": "This work is licensed under the GNU Lesser General Public License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT notice": _MIT,
    "MIT text": (
        _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software"
    ),
}
# Identifiers that an SPDX tag may name.
IDENTIFIERS: Sequence[str] = (
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
# A template's words that must be in the text, and words that must be in both or neither.
NAMES = frozenset(
    "apache boost bsd by cc cc0 eclipse gnu isc lgpl gpl agpl mit mozilla unencumbered rights reserved".split()
)
TURNS = frozenset(
    "affero lesser library nc nd sa noncommercial nonderivative noderivatives sharealike neither endorse not".split()
)
NEGATIONS = frozenset("not never no nor neither".split())

# words of a cue may lie on two lines
_BETWEEN = r"[ \t\r\n#*/;%!>|-]++(?:(?:dnl|rem)[ \t]++)?"
CUE = (
    rf"(?i)licen[sc]e|copyright|copyleft|public{_BETWEEN}domain|rights{_BETWEEN}reserved|"
    rf"permission{_BETWEEN}is{_BETWEEN}hereby|redistribution{_BETWEEN}and{_BETWEEN}use|"
    r"warranty|CC[ -]BY|CC0|SPDX|\(c\) ?[0-9]{4}|©"
)
_CUE = re.compile(CUE)
# "v. 2.0" does not end a sentence
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s)(?!(?<=\b[vV]\.)\s[0-9])|(?=\n)|\Z)")
# the "dnl" or "rem" that begins a commented line is no word of it
_WORD = re.compile(r"(?:(?<=\n)(?i:dnl|rem)\b[ \t]*)?([^\W_]+(?:\.[^\W_]+)*)")
_NUMBER = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)?\Z")
_GAP = 8  # words put in that count as much as a missing one
# matches only: this strategy with a target length leaves literals as they are, so that what a
# template saves does not depend on whether the rest of a block is worth an entropy code
_SEARCH = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=13, chain_log=12, min_match=5, target_length=1,
    strategy=zstandard.STRATEGY_FAST, write_content_size=False,
)
_CLASSES = (16, 64, 1024)  # words of short, middle and long templates


def form(word: str) -> str:
    """A word as it is compared: lower case, versions without "v" and ".0"."""
    word = word.lower()
    number = _NUMBER.match(word)
    return number[1] if number else word


def forms(text: str) -> list[str]:
    return [form(w) for w in _WORD.findall(text)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Sentences, or lines of them, that are not blank."""
    out = []
    for m in _SENTENCE.finditer(text):
        lead = len(m[0]) - len(m[0].lstrip())
        if lead < len(m[0]):
            out.append((m.start() + lead, m.end()))
    return out


@dataclass(frozen=True)
class Template:
    key: str
    license: str
    words: tuple[str, ...]
    codes: tuple[int, ...]
    telling: frozenset[str]
    tag: bool
    given: zstandard.ZstdCompressor
    gain: int  # bytes that it saves on its own text


@dataclass(frozen=True)
class Words:
    """Words of a text: where they are, what they are, the sentence they are in."""

    start: np.ndarray
    end: np.ndarray
    form: list[str]
    code: np.ndarray
    owner: np.ndarray


class Scanner:
    """Compressors and words of all templates."""

    def __init__(
        self, templates: Mapping[str, str], identifiers: Sequence[str] = IDENTIFIERS
    ):
        self.plain = zstandard.ZstdCompressor(compression_params=_SEARCH)
        texts = {n: (n, forms(t), False) for n, t in templates.items()}
        texts |= {f"SPDX {i}": (i, forms(f"SPDX-License-Identifier: {i}"), True) for i in identifiers}
        self.numbers = {w: i for i, w in enumerate(sorted({w for _, t, _ in texts.values() for w in t}))}
        self.templates = {}
        for key in sorted(texts):
            name, own, tag = texts[key]
            raw = self.raw(own)
            kept = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=_SEARCH)
            given = zstandard.ZstdCompressor(compression_params=_SEARCH, dict_data=kept)
            telling = set(own) if tag else {w for w in own if w in NAMES or w in TURNS or _NUMBER.match(w)}
            gain = len(self.plain.compress(raw)) - len(given.compress(raw))
            self.templates[key] = Template(
                key, name, tuple(own), tuple(self.numbers[w] for w in own), frozenset(telling), tag, given, gain
            )
        longest = [
            [t for t in self.templates.values() if a < len(t.words) <= b]
            for a, b in zip((0, *_CLASSES), _CLASSES, strict=False)
        ]
        self.classes = [(max(len(t.words) for t in ts), ts) for ts in longest if ts]
        self.reach = 2 * max(n for n, _ in self.classes)  # words of any notice

    @staticmethod
    def raw(found: Sequence[str]) -> bytes:
        return " ".join(found).encode("utf-8", "surrogatepass")

    def ranked(self, block: Sequence[str], templates: Sequence[Template]) -> tuple[int, list[tuple[int, Template]]]:
        """Compressed size of a block, and the bytes that each template saves, most first."""
        raw = self.raw(block)
        size = len(self.plain.compress(raw))
        saved = [(size - len(t.given.compress(raw)), t) for t in templates]
        return size, sorted(saved, key=lambda x: (-x[0], x[1].key))

    def alignments(self, codes: np.ndarray, ours: Sequence[int], share: float) -> list[tuple[int, int]]:
        """(start, end) of places, clear of each other, with enough of a template."""
        n = len(codes)
        # cost above, how far the start lies from the end of the text below: of equal costs the nearest
        step = np.arange(n + 1) << 32
        best = n - np.arange(n + 1)
        for word in ours:
            new = best + (_GAP << 32)
            hit = np.flatnonzero(codes == word)
            new[hit + 1] = np.minimum(new[hit + 1], best[hit])
            best = np.minimum.accumulate(new - step) + step
        cost, start = best >> 32, n - (best & 0xFFFFFFFF)
        matched = (_GAP * len(ours) + np.arange(n + 1) - start - cost) // (_GAP + 1)
        ends = np.flatnonzero((len(ours) - matched <= (1 - share) * len(ours)) & (matched > 0))
        out, used = [], np.zeros(n, dtype=bool)
        for end in ends[np.argsort(cost[ends], kind="stable")]:
            if not used[start[end] : end].any():
                used[start[end] : end] = True
                out.append((int(start[end]), int(end)))
        return out

    @staticmethod
    def differences(ours: Sequence[str], theirs: Sequence[str]) -> tuple[list[str], list[str]]:
        """(template words not in the text, text words beyond the template)."""
        missing, extra = [], []
        for op, a, b, c, d in SequenceMatcher(None, ours, theirs, autojunk=False).get_opcodes():
            if op != "equal":
                missing += ours[a:b]
                extra += theirs[c:d]
        return missing, extra

    def confirm(self, text: str, found: Words, t: Template, a: int, b: int, share: float):
        """(missing, extra) words of a template in the words from ``a`` to ``b``, or None if they disagree."""
        missing, extra = self.differences(t.words, found.form[a:b])
        if len(missing) > (1 - share) * len(t.words) or len(extra) > len(t.words):
            return None
        if t.telling.intersection(missing) or TURNS.intersection(extra):
            return None
        if t.tag and (extra or text[found.end[b - 1] : found.end[b - 1] + 1] in ("-", "+")):
            return None
        before = [w for i, w in enumerate(found.form[max(0, a - 2) : a], max(0, a - 2)) if found.owner[i] == found.owner[a]]
        if NEGATIONS.intersection(before):
            return None
        return missing, extra

    def winners(self, found: Words, lo: int, hi: int, close: float) -> Iterator[tuple[int, int, Template]]:
        """Blocks between two words, and the templates that compression puts first there."""
        for longest, templates in self.classes:
            for at in range(lo, max(hi - 2 * longest, lo + 1), 2 * longest):
                end = min(hi, at + 4 * longest)
                for saved, t in self.ranked(found.form[at:end], templates)[1]:
                    if saved <= 0:
                        break
                    if saved >= close * t.gain:
                        yield at, end, t

    def _confirmed(self, text: str, found: Words, lo: int, hi: int, share: float, close: float):
        """(first word, word after the last, template) of notices between two words, in order."""
        places = {}
        for at, end, t in self.winners(found, lo, hi, close):
            for a, b in self.alignments(found.code[at:end], t.codes, share):
                place = (t.key, at + a, at + b)
                if place not in places:
                    places[place] = self.confirm(text, found, t, at + a, at + b, share)
        order = sorted(
            (2 * len(d[0]) - len(self.templates[key].words), len(d[0]) - len(self.templates[key].words), len(d[1]), key, a, b)
            for (key, a, b), d in places.items() if d
        )
        out, used = [], np.zeros(hi - lo, dtype=bool)
        for _, _, _, key, a, b in order:
            if not used[a - lo : b - lo].any():
                used[a - lo : b - lo] = True
                out.append((a, b, self.templates[key]))
        return sorted(out, key=lambda x: x[:2])

    def _words(self, text: str, starts: np.ndarray) -> Words:
        got = [(m.start(1), m.end(1), form(m[1])) for m in _WORD.finditer(text)]
        at = np.array([g[:2] for g in got], dtype=np.int64).reshape(-1, 2)
        codes = np.array([self.numbers.get(g[2], -1) for g in got], dtype=np.int64)
        return Words(
            at[:, 0], at[:, 1], [g[2] for g in got], codes, np.searchsorted(starts, at[:, 0], side="right") - 1
        )

    def _row(self, text: str, found: Words, start: int, end: int, a: int, b: int, t: Template | None) -> dict:
        """A row for the text from ``start`` to ``end``, which holds a notice in words ``a`` to ``b``."""
        lo, hi = np.searchsorted(found.start, (start, end))
        if t is None:
            size, ranked = self.ranked(found.form[lo:hi], list(self.templates.values()))
            name, saved, missing, extra = None, ranked[0][0], None, None
        else:
            size, ((saved, _),) = self.ranked(found.form[lo:hi], [t])
            missing, inside = self.differences(t.words, found.form[a:b])
            name, missing = t.license, " ".join(missing)
            extra = " ".join([*found.form[lo:a], *inside, *found.form[b:hi]])
        return {
            "start": start, "end": end, "license": name, "size": size, "saved": saved / size,
            "missing": missing, "extra": extra,
        }

    def notices(self, text: str, share: float, close: float) -> list[dict]:
        """A row for every notice, and for every run of sentences with a cue but no notice."""
        cues = [m.span() for m in _CUE.finditer(text)]
        if not cues:
            return []
        starts, ends = np.array(sentences(text)).T
        cued = np.zeros(len(starts), dtype=bool)
        for a, b in cues:
            cued[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = True
        found = self._words(text, starts)
        todo: list[list[int]] = []
        for a, b in zip(*(np.searchsorted(found.start, x[cued]) for x in (starts, ends)), strict=True):
            a, b = max(0, int(a) - self.reach), min(len(found.form), int(b) + self.reach)
            if todo and a <= todo[-1][1]:
                todo[-1][1] = b
            else:
                todo.append([a, b])
        won = []
        while todo:
            lo, hi = todo.pop()
            new = self._confirmed(text, found, lo, hi, share, close) if lo < hi else []
            won += new
            edges = [lo, *[x for a, b, _ in new for x in (a, b)], hi]
            todo += [[a, b] for a, b in zip(edges[::2], edges[1::2], strict=True) if new and a < b]
        won.sort(key=lambda x: x[:2])
        out, done = [], 0
        for i, (a, b, t) in enumerate(won):
            left, right = found.owner[a], found.owner[b - 1]
            start = int(starts[left]) if starts[left] >= done else int(found.start[a])
            end = int(ends[right])
            if i + 1 < len(won):
                end = min(end, int(found.start[won[i + 1][0]]))
            done = start + len(text[start:end].rstrip())
            cued[left : right + 1] = False
            out.append((start, done, a, b, t))
        last = -2
        for i in np.flatnonzero(cued).tolist():
            if i == last + 1:
                out[-1] = (out[-1][0], int(ends[i]), 0, 0, None)
            else:
                out.append((int(starts[i]), int(ends[i]), 0, 0, None))
            last = i
        return [self._row(text, found, *x) for x in sorted(out, key=lambda x: x[:2])]

    def judge(self, block: str, share: float, close: float) -> dict:
        """The notice of a block that explains most of it, or what there is without one."""
        rows = self.notices(block, share, close)
        none = {"license": None, "size": 0, "saved": 0.0, "missing": None, "extra": None}
        return max(rows, key=lambda r: (r["license"] is not None, r["saved"]), default=none)


_KINDS = {
    "start": pa.int64(), "end": pa.int64(), "license": pa.string(), "size": pa.int64(),
    "saved": pa.float64(), "missing": pa.string(), "extra": pa.string(),
}
_FOUND = (
    "start long, end long, license string, size long, saved double, missing string, extra string"
)


def _task_scan(templates: Mapping[str, str], identifiers: Sequence[str], share: float, close: float):
    """(text, id) -> one row per notice or block without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, identifiers)
        for batch in words.slices(batches, "text"):
            rows, found = [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                got = scanner.notices(text, share, close)
                rows += [i] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(rows, pa.int64())),
                 *[pa.array([f[c] for f in found], t) for c, t in _KINDS.items()]],
                names=["id", *_KINDS],
            )

    return run


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    share: float = 0.75,
    close: float = 0.25,
    identifiers: Sequence[str] = IDENTIFIERS,
) -> DataFrame:
    """One row per notice, and per block with a cue but no notice: id, start, end (code points), license (null if
    no template is confirmed), size, saved (share of the compressed size), and the
    missing and extra words."""
    kind = docs.schema[id_col].dataType.simpleString()
    cued = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter(
        F.col("text").rlike(CUE)
    )
    return cued.mapInArrow(
        _task_scan(templates, identifiers, share, close), f"id {kind}, {_FOUND}"
    ).withColumnRenamed("id", id_col)
