"""License scan by conditional compression.

Candidate blocks are the runs of sentences that speak of licences or copyright. A sentence runs over single line breaks and
comment marks at the lines' ends, up to its own end or the paragraph's (a line without words of its own). A block is gone
through in windows of words, each twice as long as the longest notice that can be confirmed and half a window after the one
before, so that every such notice lies whole within a window; most blocks are one window. A window is compressed on its own
and with each template as a raw zstandard dictionary; templates are ranked by how much smaller that makes it. All are then
compared word by word: a template is confirmed where most of its words are in the window in order, and the words that are
missing from it, or changed, are listed; numbers and words that name a licence or a variant must agree. Among the confirmed the one
with the highest share of its words found wins, then the longest, then the largest reduction. Its words are taken and the rest is
compared again, until no template is confirmed. Templates found word for word are taken first, in the whole block. A template too
few of whose words are in the window at all is skipped, and so is a window without any other, which changes no result.

The work grows in proportion to the text, also where one line holds keywords throughout. Only texts that hold a keyword reach
Python; they are scanned whole.

Defined results: null and empty texts and texts without a keyword give no rows, and neither does an empty table; a block that no
template explains gives a row with license null, verdict 'unknown' and the reduction of the window that has the highest share of
a template's words; equal reductions rank by license name, then by template; repeated rows give equal rows; several blocks of a
document give a row each, and so does each notice confirmed in a block, with the block's start and chars; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import map_rows

LEVEL, CONFIRM, MAX_MISSING = 19, 0.8, 0.34
_REMEMBERED = 10_000  # characters of a block whose result a task keeps for the next like it
KEYWORDS = r"licen[sc]e|copyright|©|all rights reserved|spdx|public domain|permission is hereby|redistribution and use|without warranty|creative commons|\bcc by\b|\bcc0\b"
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.", "SPDX-License-Identifier: MIT"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "The person who associated a work with this deed has dedicated the work to the public domain."],
    "public-domain": ["This work is in the public domain."],
    "all-rights-reserved": ["All rights reserved."],
}
_KEY = re.compile(KEYWORDS.replace(" ", r"\s+"), re.IGNORECASE)  # once comment marks are blanks
#: Comment marks, with the blanks around them, at a line's begin.
_MARK = re.compile(r"[^\S\n]*+(?:<!--+|/{2,}|/?\*+/?|#+|;+|--+|%+|>+|\"{3}|'{3})[^\S\n]*+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_BEGIN, _END = re.compile(r"[.!?]\s+(?!\d)"), re.compile(r"[.!?](?=\s|$)(?!\s+\d)")  # "v. 2.0" and the like: a sentence doesn't end before a number
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def _body(line: str) -> tuple[int, int]:
    """Where the line begins and ends without its comment marks and the blanks around them."""
    m = _MARK.match(line)
    begin, rest = m.end() if m else 0, line.rstrip()
    core = rest[:-1].rstrip("*") if rest.endswith("*/") else rest[:-1].rstrip("-") if rest.endswith("-->") else rest.rstrip("#") if rest.endswith("#") else rest.rstrip("*")
    return begin, max(begin, len(core.rstrip()) if core != rest else len(line))


def unmarked(text: str) -> str:
    """The text with blanks for comment marks, so that positions stay."""
    out = []
    for line in text.split("\n"):
        begin, end = _body(line)
        out.append(" " * begin + line[begin:end] + " " * (len(line) - end) if begin or end < len(line) else line)
    return "\n".join(out)


def unwrapped(block: str) -> str:
    """The block in one line; a word broken behind its hyphen is whole again."""
    return " ".join(re.sub(r"(?<=\w-)[^\S\n]*\n\s*(?=\w)", "", block).split())


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of the candidate blocks: keyword sentences; adjacent ones of a paragraph, or of lines that follow each other, are one block.

    Nothing before the last block's end is looked at again.
    """
    out: list[tuple[int, int]] = []
    text = unmarked(text)
    begin_paragraph, end_paragraph, behind = 0, 0, 0
    for m in _KEY.finditer(text):
        at = m.start()
        if out and at < out[-1][1]:
            continue
        while behind <= at:
            gap = _PARAGRAPH.search(text, behind)
            begin_paragraph, end_paragraph, behind = behind, gap.start() if gap else len(text), gap.end() if gap else len(text) + 1
        low = max(begin_paragraph, out[-1][1] if out else 0)
        begin = max((x.end() for x in _BEGIN.finditer(text, low, at)), default=low)
        stop = _END.search(text, at, min(end_paragraph + 1, len(text)))
        end = stop.end() if stop else end_paragraph
        begin += len(text[begin:at]) - len(text[begin:at].lstrip())
        end -= len(text[begin:end]) - len(text[begin:end].rstrip())
        if out and not text[out[-1][1] : begin].strip() and not _PARAGRAPH.search(text, out[-1][1], begin):
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def _size(data: bytes, dictionary: bytes | None) -> int:
    return len(_compressor(dictionary).compress(data))


@lru_cache(maxsize=256)
def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(compression_params=params, dict_data=raw)


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _compared(block: list[str | None], template: list[str]) -> tuple[float, list[str], list[str | None], list[int]]:
    missing, instead, places = [], [], []
    codes = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    for k, (op, a, b, c, d) in enumerate(codes):
        if op == "equal":
            places += range(c, d)
            continue
        missing += template[a:b]
        if 0 < k < len(codes) - 1:  # what stands before and after the notice isn't part of it
            instead += block[c:d]
    return len(places) / max(1, len(template)), missing, instead, places


def differences(block: list[str], template: list[str]) -> tuple[float, list[str], list[str]]:
    """(share of the template's words found in order, words missing, words in their place)."""
    return _compared(block, template)[:3]


def rank(block: str, templates: dict[str, list[str]]) -> list[tuple[float, str, str]]:
    """(reduction, license, template), best first."""
    data = block.encode("utf-8", "replace")
    alone = _size(data, None)
    found = [(1 - _size(data, t.encode()) / alone, name, t) for name, texts in templates.items() for t in texts]
    return sorted(found, key=lambda x: (-x[0], x[1], x[2]))


def _reach(n: int) -> float:
    """How many words of a template of n words may be missing or changed."""
    return max(1, MAX_MISSING * n)


class Notices:
    """Templates with what is needed to find them."""

    def __init__(self, templates: dict[str, list[str]]):
        self.templates = templates
        self.own = {t: _words(t) for texts in templates.values() for t in texts}
        self.counts = {t: Counter(w) for t, w in self.own.items()}
        #: The most words that a confirmed notice can span.
        self.span = max((int(len(w) + _reach(len(w))) for w in self.own.values()), default=1)
        self.exact = sorted(((name, t) for name, texts in templates.items() for t in texts if self.own[t]), key=lambda x: (-len(self.own[x[1]]), x))

    def share(self, template: str, there: Counter) -> float:
        """No more of the template's words can be found in order than there are at all."""
        return sum(min(n, there[w]) for w, n in self.counts[template].items()) / max(1, len(self.own[template]))

    def confirmed(self, words: list[str | None], ranked: list[tuple[float, str, str]]) -> tuple[dict, list[int]] | None:
        """The best confirmed template and the places of its words among ``words``; None is a word that is taken."""
        best = None
        there = Counter(words)
        for reduction, name, template in ranked:
            own = self.own[template]
            if self.share(template, there) < CONFIRM:
                continue
            share, missing, instead, places = _compared(words, own)
            if share >= CONFIRM and len(missing) + len(instead) <= _reach(len(own)):
                exact = not missing and not instead
                # A version or variant word that differs names another licence; without exact wording numbers must agree.
                if not exact and ({w for w in missing if any(c.isdigit() for c in w)} or any(w in _TELLING for w in [*missing, *instead])):
                    continue
                key = (share, len(own) if exact else 0, reduction)
                if best is None or key > best[0]:
                    found = {"license": name, "reduction": round(reduction, 6), "share": round(share, 6), "missing": missing, "instead": [w for w in instead if w], "verdict": "exact" if exact else "changed"}
                    best = (key, found, places)
        return best and best[1:]

    def find(self, block: str) -> list[dict]:
        """The confirmed templates whose matched words don't overlap, in the order in which they are taken; one 'unknown' if there are none."""
        spans = [(m.start(), m.end()) for m in _WORD.finditer(block)]
        words: list[str | None] = [block[a:b].lower() for a, b in spans]
        step = self.span
        starts = range(0, max(1, len(words) - step), step)
        ranks: dict[int, list[tuple[float, str, str]]] = {}

        def ranked(start: int) -> list[tuple[float, str, str]]:
            if start not in ranks:
                part = spans[start : start + 2 * step]
                ranks[start] = rank(block[part[0][0] : part[-1][1]] if len(starts) > 1 else block, self.templates)
            return ranks[start]

        out = []
        for at, name, template in self._word_for_word(words):
            reduction = next(r for r, n, t in ranked(min(at // step * step, starts[-1])) if (n, t) == (name, template))
            out.append({"license": name, "reduction": round(reduction, 6), "share": 1.0, "missing": [], "instead": [], "verdict": "exact"})
        closest = (-1.0, 0)
        for start in starts:
            part = words[start : start + 2 * step]
            there = Counter(part)
            most = max((self.share(t, there) for t in self.own), default=0.0)
            closest = max(closest, (most, -start))
            if most < CONFIRM:
                continue
            while found := self.confirmed(part, ranked(start)):
                # What begins in the second half may run beyond the window and is left to the next one.
                if found[1][0] < step or start == starts[-1]:
                    out.append(found[0])
                    for k in found[1]:
                        words[start + k] = None
                for k in found[1]:
                    part[k] = None
        return out or [{"license": None, "reduction": round(ranked(-closest[1])[0][0], 6) if spans else None, "share": None, "missing": [], "instead": [], "verdict": "unknown"}]

    def _word_for_word(self, words: list[str | None]) -> list[tuple[int, str, str]]:
        """(place, license, template) of whole templates, the longest first; their words are taken."""
        joined = "\0" + "\0".join(w or "" for w in words) + "\0"
        begins, at = [], 0
        for w in words:
            begins.append(at)
            at += len(w or "") + 1
        out = []
        for name, template in self.exact:
            own = self.own[template]
            sought = "\0" + "\0".join(own) + "\0"
            at = joined.find(sought)
            while at >= 0:
                k = bisect_left(begins, at)
                if None not in words[k : k + len(own)]:
                    out.append((k, name, template))
                    words[k : k + len(own)] = [None] * len(own)
                at = joined.find(sought, at + 1)
        return out


@lru_cache(maxsize=1)
def _known() -> Notices:
    return Notices(TEMPLATES)


def classify_all(block: str, templates: dict[str, list[str]] | None = None) -> list[dict]:
    """``Notices.find`` with the given templates."""
    return (Notices(templates) if templates else _known()).find(block)


def classify(block: str, templates: dict[str, list[str]] | None = None) -> dict:
    """The first of ``classify_all``."""
    return classify_all(block, templates)[0]


_TELLING = {"apache", "mit", "gnu", "lesser", "affero", "bsd", "mozilla", "cc", "cc0", "by", "by-sa", "by-nc", "by-nc-nd", "noncommercial", "sharealike", "attribution-sharealike", "attribution-noncommercial", "not"}

SCHEMA = "doc_id long, start long, chars long, license string, reduction double, share double, missing array<string>, instead array<string>, verdict string"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each notice confirmed in a candidate block, or for the block: (doc_id, start, chars, license, reduction, share, missing, instead, verdict)."""
    notices = Notices(templates or TEMPLATES)
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[dict]] = {}
        for f in frames:
            rows = []
            for i, text in zip(f["doc_id"], f["text"]):
                clean = unmarked(text)
                for a, b in blocks(text):
                    block = unwrapped(clean[a:b])
                    found = known.get(block)
                    if found is None:
                        found = notices.find(block)
                        if len(known) > 10_000:
                            known.clear()
                        if len(block) <= _REMEMBERED:
                            known[block] = found
                    rows += [{"doc_id": i, "start": a, "chars": b - a, **x} for x in found]
            yield pd.DataFrame(rows, columns=columns)

    return map_rows(docs.select("doc_id", "text").where(F.col("text").rlike("(?i)" + KEYWORDS.replace(" ", r"\W+"))), run, SCHEMA)
