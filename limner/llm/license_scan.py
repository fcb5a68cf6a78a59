"""License scan by conditional compression.

Around each cue word, windows of the text are compressed with every template of about their size as a raw dictionary. The bytes that
a dictionary saves nominate its template, if they are enough for the template's own size, and rank the nominations. They are
taken from the top: a template is confirmed by comparing its wording word by word with the window, and the differences are part of the result. What is
confirmed is masked, the windows it lay in are compressed and ranked anew, and so on until no nomination passes.
All wordings that are found are told, not the best alone.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from limner.llm.words import tidy

# The opening or notice text of public licenses.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

CUES = re.compile(rb"licen[cs]|copyright|spdx|permission|redistribut|warrant|public domain|rights reserved|creative commons|free software|unencumbered|\bcc[ -]by|\bcc0")
#: Lines without cue between two cue lines of one block, at most.
GAP = 6
#: What a template as dictionary must save on a window to be nominated, as a share of what it saves on itself; so many bytes are noise.
MIN_COVERED, NOISE = 0.15, 16
#: Different words a variant may have, as a share of the template's.
MAX_DIFFERENT = 0.2
#: Words that tell one license from another: a wording that differs in one of them is no variant.
NAMES = frozenset("mit apache bsd isc gnu lesser library affero mozilla mpl cc sa nc nd attribution sharealike noncommercial noderivatives noderivs cc0 unencumbered".split())
#: Sizes of templates, in characters, that share windows; larger templates have windows of their own.
SIZES = (160, 640, 2_560, 10_240)
_WORD = re.compile(r"[^\W_]+")
_CUED = re.compile(CUES.pattern.decode(), re.IGNORECASE | re.ASCII)
_BATCH_CHARS = 16 << 20


@dataclass(frozen=True)
class Finding:
    license: str | None
    verdict: str
    reduction: float
    n_different: int
    differences: str


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str, gap: int = GAP) -> list[tuple[int, int, str]]:
    """First line, end line and text of each candidate block."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if not CUES.search(raw):
        return []
    found: list[list[int]] = []
    for i, line in enumerate(raw.split(b"\n")):
        if CUES.search(line):
            if found and i - found[-1][1] <= gap:
                found[-1][1] = i + 1
            else:
                found.append([i, i + 1])
    lines = text.split("\n")
    return [(a, b, "\n".join(lines[a:b])) for a, b in found]


@lru_cache(1)
def all_templates() -> dict[str, list[str]]:
    """The notices of ``TEMPLATES`` and the whole license texts of the folder ``licenses``."""
    folder = resources.files(__package__) / "licenses"
    bodies = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    return {name: [*TEMPLATES.get(name, []), *([bodies[name]] if name in bodies else [])] for name in sorted({*TEMPLATES, *bodies})}


def wording(part: list[str], template: list[str]) -> list[tuple[str, str]]:
    """The words by which a stretch of a text differs from a template: (of the template, of the text)."""
    steps = SequenceMatcher(None, template, part, autojunk=False).get_opcodes()
    return [(" ".join(template[a:b]), " ".join(part[c:d])) for kind, a, b, c, d in steps if kind != "equal"]


def _distances(template: np.ndarray, words: np.ndarray, anywhere: bool) -> np.ndarray:
    """Word edit distance of the template to the stretches that end before each place; they start anywhere or at the first word."""
    places = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64) if anywhere else places.copy()
    for i, word in enumerate(template.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    return row


def _windows(cues: list[int], length: int, size: int) -> list[tuple[int, int]]:
    """Windows of twice ``size``, each beginning ``size`` after the one before, over all that lies within ``size`` of a cue: a wording with a cue is in one of them whole."""
    found: list[tuple[int, int]] = []
    at = 0
    while at < len(cues):
        low, last = max(cues[at] - size, 0), cues[at]
        while at < len(cues) and cues[at] <= last + 2 * size:
            last = cues[at]
            at += 1
        high = min(last + size, length)
        found += [(x, min(x + 2 * size, high)) for x in range(low, max(high - size, low + 1), size)]
    return found


#: Words that are part of a confirmed wording.
_MASKED = -2


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    ids: np.ndarray
    allowed: int


class Scanner:
    def __init__(self, templates: dict[str, list[str]] | None = None):
        self.templates = [(name, text, words_of(text)) for name, texts in sorted((templates or all_templates()).items()) for text in texts]
        plain = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**plain)
        self.given, self.own = [], []
        self.number: dict[str, int] = {}
        self.wanted = []
        for name, text, words in self.templates:
            raw = text.lower().encode()
            given = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain)
            self.given.append(given)
            self.own.append(len(self.plain.compress(raw)) - len(given.compress(raw)))
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64)
            self.wanted.append(Template(name, words, ids, int(MAX_DIFFERENT * len(words))))
        self.classes = self._classes()
        self.judge = lru_cache(1 << 14)(self._judge)
        self.unknown = lru_cache(1 << 14)(lambda block: Finding(None, "unknown", max(self.reductions(block)), 0, ""))

    def reductions(self, block: str) -> list[float]:
        """By what share each template as a dictionary shrinks the compressed block."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return [1 - len(given.compress(raw)) / alone for given in self.given]

    def _classes(self) -> list[tuple[int, list[int]]]:
        """Templates by size, the largest first: what a window has to hold, and the numbers of the templates."""
        found: dict[int, list[int]] = {}
        for k, (_, text, _) in enumerate(self.templates):
            found.setdefault(next((size for size in SIZES if len(text) <= size), len(text)), []).append(k)
        return [(int(size * (1 + MAX_DIFFERENT)) + 16, found[size]) for size in sorted(found, reverse=True)]

    def saved(self, k: int, window: str) -> int:
        """Bytes that a template as dictionary saves on a window."""
        raw = window.lower().encode("utf-8", "surrogatepass")
        return len(self.plain.compress(raw)) - len(self.given[k].compress(raw))

    def nominated(self, window: str, among: list[int]) -> list[tuple[int, float, int]]:
        """Templates that save enough on a window: bytes, their share of what the template saves on itself, and its number; best first."""
        if len(window.strip()) < 8:
            return []
        raw = window.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        found = []
        for k in among:
            saved = alone - len(self.given[k].compress(raw))
            if saved + NOISE >= MIN_COVERED * self.own[k]:
                found.append((saved, saved / self.own[k], k))
        return sorted(found, key=lambda x: (-x[0], -x[1], x[2]))

    def _confirmed(self, k: int, words: list[str], ids: np.ndarray, text: str, bounds: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int, Finding]]:
        """First word, end word and finding of the stretches of words ``a`` to ``b`` that are a template's wording; none overlap."""
        t, found = self.wanted[k], []
        if b - a < len(t.words) - t.allowed:
            return found
        ends = _distances(t.ids, ids[a:b], True)
        taken = np.zeros(b - a, bool)
        near = np.flatnonzero(ends <= t.allowed)
        for end in near[np.argsort(ends[near], kind="stable")].tolist():
            # a variant that does not overlap another one ends so many words after it at least
            if not end or taken[max(end - len(t.words) + t.allowed, 0) : end].any():
                continue
            low = max(end - len(t.words) - t.allowed, 0)
            back = _distances(t.ids[::-1], ids[a + low : a + end][::-1], False)
            start = end - int(np.flatnonzero(back == back.min())[0])
            if start >= end or taken[start:end].any():
                continue
            taken[start:end] = True
            steps = wording(words[a + start : a + end], t.words)
            n = sum(max(len(x.split()), len(y.split())) for x, y in steps)
            # another number is another version, another name another license
            other = any(re.search(r"\d", x + y) or not NAMES.isdisjoint(f"{x} {y}".split()) for x, y in steps)
            if n <= t.allowed and not other and (ids[a + start : a + end] != _MASKED).all():
                own = text[bounds[a + start][0] : bounds[a + end - 1][1]].lower().encode("utf-8", "surrogatepass")
                gain = 1 - len(self.given[k].compress(own)) / len(self.plain.compress(own))
                told = "; ".join(f"{x or '-'} > {y or '-'}" for x, y in steps)
                found.append((a + start, a + end, Finding(t.name, "variant" if n else "exact", gain, n, told)))
        return found

    def findings(self, text: str) -> list[tuple[int, int, Finding]]:
        """First and end character and finding of every license wording of a text, in order; none overlap."""
        cues = [m.start() for m in _CUED.finditer(text)]
        if not cues:
            return []
        bounds = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in bounds]
        ids = np.array([self.number.get(w, -1) for w in words], np.int64)
        starts, stops = (np.array([x[i] for x in bounds], np.int64) for i in (0, 1))
        shown, found = list(text), []
        for size, among in self.classes:
            spans = _windows(cues, len(text), size)
            agenda, version = [], [0] * len(spans)

            def rank(i: int) -> None:
                for saved, share, k in self.nominated("".join(shown[spans[i][0] : spans[i][1]]), among):  # noqa: B023
                    heapq.heappush(agenda, (-saved, i, -share, k, version[i]))  # noqa: B023

            for i in range(len(spans)):
                rank(i)
            while agenda:
                top = heapq.heappop(agenda)
                i, level = top[1], [top[3]] if top[4] == version[top[1]] else []
                # of equal reductions of a window, the wording decides: fewer different words, then more words
                while agenda and agenda[0][:2] == top[:2]:
                    *_, k, then = heapq.heappop(agenda)
                    if then == version[i] and k not in level:
                        level.append(k)
                a, b = int(np.searchsorted(starts, spans[i][0])), int(np.searchsorted(stops, spans[i][1], "right"))
                every = [x for k in level for x in self._confirmed(k, words, ids, text, bounds, a, b)]
                for first, end, finding in sorted(every, key=lambda x: (x[2].n_different, x[0] - x[1], x[0])):
                    if (ids[first:end] == _MASKED).any():
                        continue
                    low, high = bounds[first][0], bounds[end - 1][1]
                    found.append((low, high, finding))
                    ids[first:end] = _MASKED
                    shown[low:high] = " " * (high - low)
                    for j in range(max(i - 2, 0), min(i + 3, len(spans))):
                        if spans[j][0] < high and low < spans[j][1]:
                            version[j] += 1
                            rank(j)
        return sorted(found, key=lambda x: x[:2])

    def _judge(self, block: str) -> Finding:
        """The finding of a block that is told of it first: the one with the fewest different words."""
        return min((f for _, _, f in self.findings(block)), key=lambda f: f.n_different, default=None) or self.unknown(block)

    def scan(self, text: str) -> list[tuple[int, int, Finding, int, int]]:
        """First line, end line, finding, and first and end character of each wording, and of each block that has none."""
        cued = blocks(text)
        if not cued:
            return []
        rows, used = [], set()
        breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
        begins = np.concatenate(([0], breaks + 1))
        for a, b, f in self.findings(text):
            first, end = int(np.searchsorted(breaks, a)), int(np.searchsorted(breaks, b - 1)) + 1
            used.update(i for i, (x, y, _) in enumerate(cued) if x < end and first < y)
            rows.append((first, end, f, a, b))
        rows += [(x, y, self.unknown(block), int(begins[x]), int(begins[x]) + len(block)) for i, (x, y, block) in enumerate(cued) if i not in used]
        return sorted(rows, key=lambda r: (r[0], r[1], r[3]))


_FINDINGS = pa.schema([
    ("doc_id", pa.int64()), ("first_line", pa.int64()), ("end_line", pa.int64()), ("license", pa.string()), ("verdict", pa.string()),
    ("reduction", pa.float64()), ("n_different", pa.int64()), ("differences", pa.string()), ("first_char", pa.int64()), ("end_char", pa.int64()), ("block", pa.string()),
])


def _rows_of(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _FINDINGS, strict=True)], schema=_FINDINGS)


def _scanned(templates):
    @tidy
    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows: list[list] = [[] for _ in _FINDINGS]
            held = 0
            ids = batch.column("doc_id")
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                for first, end, found, a, b in scanner.scan(text):
                    values = (ids[i].as_py(), first, end, found.license, found.verdict, found.reduction, found.n_different, found.differences, a, b, text[a:b])
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    held += b - a
                if held > _BATCH_CHARS:
                    yield _rows_of(rows)
                    rows, held = [[] for _ in _FINDINGS], 0
            yield _rows_of(rows)

    return run


def license_blocks(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per license wording and per candidate block without one, of every row and whole text of ``docs(doc_id, text)``.

    ``doc_id, first_line, end_line, license, verdict, reduction, n_different, differences, first_char, end_char, block``. The verdict is ``exact``,
    ``variant`` (few words differ, none of them a number or a license's name) or ``unknown`` (a cue, but no known wording; ``license``
    is null). A block with several licenses, or with one license twice, gives a row for each; lines, characters and the text ``block`` are those of the
    wording, or of the candidate block without one, so that the result is never longer than the texts. A wording may reach over several blocks, like a whole license text,
    or be part of a line. Null and empty texts have no block; rows that repeat a ``doc_id`` or have none are scanned like others.
    """
    schema = "doc_id long, first_line long, end_line long, license string, verdict string, reduction double, n_different long, differences string, first_char long, end_char long, block string"
    return docs.select("doc_id", "text").mapInArrow(_scanned(templates or all_templates()), schema)
