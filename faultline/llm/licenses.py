"""License scans by conditional compression (operator 2).

Spark keeps the texts that hold a cue word. In them every cue gives candidate blocks: the words
around it, as many as the templates of a size class have, over line ends and comment signs, so
wrapped notices and whole license texts lie in one block. Each block is compressed once plainly
and once with each template of its class as a raw zstandard dictionary; the templates are ranked
by the bytes saved. In this order they are confirmed by exact wording, each in what the ones
before it left of the block: the words there are aligned with the template's, and what the template has
beyond them (`missing`) and they have between the template's words (`extra`) is listed. It is confirmed if no
key word of the template (what tells it from its siblings: a version, NC, SA ...) is missing, no
sibling's key word or QUALIFIER stands in between, at least `min_words` of its words are there in order, and no
more than the rest is extra. One that is not confirmed leaves the block to the next.

Of winners of several blocks whose spans overlap the one that saves most bytes stays (of equals the one
with most words confirmed, then the first in the list), so a text may hold several licenses. SPDX expressions are read as such: each
identifier counts, known ones in their usual spelling, others as written, with its plus sign if it has one. What follows WITH is
no license. Operators in lower case may be prose, so after them only known identifiers count. Identifiers
that are not in the list are of the kind `unlisted`; `scan` leaves them out unless asked for them.

Result: doc_id, start, end (code points), kind (name, notice, text, spdx, unlisted), license, reduction,
missing, extra, exact; a row for each license found in each input row.

Defined results: null and empty texts have no rows; repeated rows are reported each; a null
doc_id is kept; an empty table or no templates give no row; other columns are ignored. What is
kept of a long text are its distinct blocks, so a line that repeats is confirmed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import texts_in_batches

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {0} License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version."
_WORK = "This work is licensed under the GNU {0} License, version {1}."
_CC = "This work is licensed under a Creative Commons {0} {1} {2} License."

# The parts, licenses, versions and forms of the Creative Commons family; names and versions of the GNU family.
_CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
_CC_CODES = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_GNU = {"GPL": ("General Public", ("2.0", "3.0")), "LGPL": ("Lesser General Public", ("2.1", "3.0")), "AGPL": ("Affero General Public", ("3.0",))}
#: Words that make another license of one, where they stand between its words; so in no template they block as well.
QUALIFIERS = frozenset("non noncommercial commercial no noderivatives noderivs derivatives derivative share sharealike alike lesser library affero jurisdiction ported".split())


def _creative_commons() -> list[tuple[str, str, str, str]]:
    out = []
    for code in _CC_CODES:
        words = [_CC_PARTS[p] for p in code.split("-")]
        for version, form in _CC_VERSIONS.items():
            name, short, long = f"CC-{code}-{version}", f"cc {code.replace('-', ' ').lower()} {version}", f"creative commons {' '.join(words).lower()} {version}"
            out += [(name, "notice", f"Licensed under CC {code} {version}.", short), (name, "name", f"CC {code} {version}", short)]
            out += [(name, "notice", _CC.format("-".join(words), version, form), long), (name, "name", f"Creative Commons {'-'.join(words)} {version}", long)]
    return out


def _gnu() -> list[tuple[str, str, str, str]]:
    out = []
    for short, (long, versions) in _GNU.items():
        first = long.lower().replace(" public", "")
        for v in versions:
            name, n = f"{short}-{v}", v.removesuffix(".0")
            out += [(name, "notice", _WORK.format(long, n), f"gnu {first} {n}"), (f"{name}-or-later", "text", _GPL.format(long, n), f"gnu {first} {n} later redistribute program"), (f"{name}-or-later", "text", _LIBRARY.format(long, n), f"gnu {first} {n} later redistribute library")]
            for x in dict.fromkeys((v, n)):
                out += [(name, "name", f"GNU {long} License v{x}", f"gnu {first} v{x}"), (name, "name", f"GNU {long} License version {x}", f"gnu {first} version {x}"), (name, "name", f"GNU {short} v{x}", f"gnu {short.lower()} v{x}"), (name, "name", f"GNU {short} {x}", f"gnu {short.lower()} {x}"), (name, "name", f"{short} {x}", f"{short.lower()} {x}"), (name, "name", f"{short} v{x}", f"{short.lower()} v{x}")]
            joined = f"{short}v{n}"
            out += [(name, "name", joined, " ".join(words_of(joined)))]
    return out


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_WORD = re.compile(r"v?[0-9]+(?:\.[0-9]+)*|[^\W_]+")

# Fixed values: (license, kind, wording, key words), wordings as the licenses or their stewards give them.
TEMPLATES = (
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "text", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2.0 compliance"),
    ("Apache-2.0", "name", "Apache License 2.0", "apache 2.0"),
    ("Apache-2.0", "name", "Apache License, Version 2.0", "apache 2.0"),
    ("MIT", "notice", "Released under the MIT License.", "mit"),
    ("MIT", "notice", "Licensed under the MIT License.", "mit"),
    ("MIT", "name", "MIT License", "mit license"),
    ("MIT", "name", "MIT licensed", "mit licensed"),
    ("MIT", "notice", "Dual licensed under MIT", "dual mit"),
    ("EPL-2.0", "name", "Eclipse Public License 2.0", "eclipse public 2.0"),
    ("EPL-2.0", "name", "Eclipse Public License, Version 2.0", "eclipse public 2.0"),
    ("EPL-2.0", "name", "Eclipse Public License v2.0", "eclipse public v2.0"),
    ("EPL-1.0", "name", "Eclipse Public License 1.0", "eclipse public 1.0"),
    ("EPL-1.0", "name", "Eclipse Public License v1.0", "eclipse public v1.0"),
    ("BSL-1.0", "name", "Boost Software License 1.0", "boost 1.0"),
    ("BSL-1.0", "name", "Boost Software License, Version 1.0", "boost 1.0"),
    ("MIT", "notice", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', "permission granted free charge deal restriction"),
    ("MIT", "text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', "sublicense noninfringement furnished"),
    ("ISC", "text", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.', "fee disclaims appear"),
    ("CC0-1.0", "notice", "This work is dedicated to the public domain under CC0 1.0 Universal.", "cc0 1.0"),
    ("BSD-2-Clause", "text", _BSD, "redistributions retain reproduce disclaimer"),
    ("BSD-3-Clause", "text", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistributions retain reproduce disclaimer neither endorse promote"),
    ("BSD-3-Clause", "name", "BSD 3-Clause License", "bsd 3 clause"),
    ("BSD-2-Clause", "name", "BSD 2-Clause License", "bsd 2 clause"),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2.0"),
    ("MPL-2.0", "name", "Mozilla Public License 2.0", "mozilla public 2.0"),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    *_gnu(),
    *_creative_commons(),
)
# Identifiers in SPDX expressions.
SPDX = ("0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib")
CUE = r"(?i)licen[sc]e|permission (?:is hereby|to use)|redistribution|creative commons|public domain|spdx|\bcc[ -]by|\bcc0"
LEVEL = 3
#: Size classes of templates in words; a block of a class has so many words, and SLACK, on both sides of a cue.
CLASSES, SLACK = (12, 50, 300), 4

_CUE = re.compile(CUE)
_SPDX = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*")
_SPDX_PART = re.compile(r"[( \t]*([A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)(\+?)[) \t]*")
_SPDX_OPERATOR = re.compile(r"(AND|OR|WITH|and|or|with|/|,)(?=[( \t])|/")
_SPELLING = {x.lower(): x for x in SPDX}


@dataclass
class Template:
    license: str
    kind: str
    words: list[str]
    keys: set[str]
    packer: zstandard.ZstdCompressor


def _packer(text: str) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))


@lru_cache(4)
def prepared(templates: tuple[tuple[str, str, str, str], ...]) -> tuple[list[Template], zstandard.ZstdCompressor, set[str]]:
    made = [Template(name, kind, words_of(text), set(keys.split()), _packer(text)) for name, kind, text, keys in templates]
    return made, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), set().union(*(t.keys for t in made)) if made else set()


def wording(block: list[str], template: Template) -> tuple[list[str], list[str], int, int]:
    """(missing, extra, first, last): template words not in the block in order; block words between the first and last that match; these two as places in the block."""
    same = [m for m in SequenceMatcher(None, block, template.words, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return list(template.words), [], 0, -1
    have = {i for m in same for i in range(m.b, m.b + m.size)}
    inside = {i for m in same for i in range(m.a, m.a + m.size)}
    first, last = same[0].a, same[-1].a + same[-1].size - 1
    return [w for i, w in enumerate(template.words) if i not in have], [block[i] for i in range(first, last + 1) if i not in inside], first, last


@dataclass(frozen=True)
class Found:
    """first and last: words of the block, or of the text."""

    first: int
    last: int
    saved: int
    place: int
    reduction: float
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    agree: int


def confirmed(block: list[str], text: str, size: int, templates: tuple[tuple[str, str, str, str], ...] = TEMPLATES, min_words: float = 0.8) -> list[Found]:
    """Templates of a size class that a block holds; text is the block's."""
    made, plain, keys = prepared(templates)
    least = max([c for c in CLASSES if c < size], default=0)
    data = text.encode("utf-8", "replace")
    whole = len(plain.compress(data))
    ranked = sorted(((whole - len(t.packer.compress(data)), -k) for k, t in enumerate(made) if least < len(t.words) <= size), reverse=True)
    out = []
    free = [(0, len(block))]  # what no winner has taken
    for saved, k in ranked:
        t = made[-k]
        room = (1 - min_words) * len(t.words)
        parts, free = free, []
        while parts:
            low, high = parts.pop()
            if high - low >= len(t.words) - room and t.keys <= set(block[low:high]):  # a missing key word shows without an alignment
                missing, extra, first, last = wording(block[low:high], t)
                odd = ((keys | QUALIFIERS) - t.keys - set(t.words)) & set(extra)
                if not t.keys & set(missing) and not odd and len(missing) <= room and len(extra) <= room:
                    out.append(Found(low + first, low + last, saved, -k, saved / whole, tuple(missing), tuple(extra), len(t.words) - len(missing) - len(extra)))
                    parts += [(low, low + first), (low + last + 1, high)]  # there may be another
                    continue
            free.append((low, high))
    return out


def expression(text: str, at: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, identifier) of the licenses in the SPDX expression that begins there."""
    operator = "AND"
    while part := _SPDX_PART.match(text, at):
        known = _SPELLING.get(part[1].lower())
        if operator.islower() and not known:
            return
        if operator.upper() != "WITH":
            yield part.start(1), part.end(2), (known or part[1]) + part[2]
        follows = _SPDX_OPERATOR.match(text, part.end())
        if not follows:
            return
        operator, at = follows[0], follows.end()


def scan(text: str, templates: tuple[tuple[str, str, str, str], ...] = TEMPLATES, known: dict | None = None, unlisted: bool = False) -> list[tuple]:
    """(start, end, kind, license, reduction, missing, extra, exact) of every license in a text. known: blocks that were confirmed before."""
    known = {} if known is None else known
    spans = [m.span() for m in _WORD.finditer(text)]
    lower = [text[a:b].lower() for a, b in spans]
    found: set[Found] = set()
    at = 0
    for cue in _CUE.finditer(text):
        while at < len(spans) and spans[at][1] <= cue.start():
            at += 1
        for size in CLASSES:
            low, high = max(0, at - size - SLACK), min(len(spans), at + size + SLACK + 1)
            if low >= high:
                continue
            part = text[spans[low][0] : spans[high - 1][1]]
            if (part, size) not in known:
                if len(known) >= 10_000:
                    known.clear()
                known[part, size] = confirmed(lower[low:high], part, size, templates)
            found |= {Found(low + f.first, low + f.last, f.saved, f.place, f.reduction, f.missing, f.extra, f.agree) for f in known[part, size]}
    rows, taken = [], []
    made = prepared(templates)[0]
    for m in _SPDX.finditer(text) if made else ():
        end = m.end()
        for a, b, name in expression(text, end):
            data, line = text[m.start() : b].encode(), f"SPDX-License-Identifier: {name}"
            end, kind = b, "spdx" if name.removesuffix("+").lower() in _SPELLING else "unlisted"
            if kind == "spdx" or unlisted:
                rows.append((a, b, kind, name, 1 - len(_packer(line).compress(data)) / len(prepared(templates)[1].compress(data)), "", "", True))
        taken.append((m.start(), end))
    for f in sorted(found, key=lambda f: (-f.saved, -f.agree, f.place, f.first)):
        a, b = spans[f.first][0], spans[f.last][1]
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            t = made[f.place]
            rows.append((a, b, t.kind, t.license, f.reduction, " ".join(f.missing), " ".join(f.extra), not f.missing and not f.extra))
    return sorted(rows)


def licenses(docs: DataFrame, templates: tuple[tuple[str, str, str, str], ...] = TEMPLATES) -> DataFrame:
    texts_in_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(CUE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # notices repeat word for word
        for b in batches:
            rows = [(doc, *r) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in scan(t, templates, known, True)]
            names = ["doc_id", "start", "end", "kind", "license", "reduction", "missing", "extra", "exact"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return source.mapInArrow(run, "doc_id long, start int, end int, kind string, license string, reduction double, missing string, extra string, exact boolean")
