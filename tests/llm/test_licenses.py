import textwrap
import time

import pytest

from faultline.llm.licenses import TEMPLATES, licenses, scan, words_of
from faultline.llm.shared import table

SF = "/root/testdata/sf0.01"
WORDING = {(name, kind): text for name, kind, text, _ in TEMPLATES}
CASES = [
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("licensed under CC-BY-SA 4.0", ["CC-BY-SA-4.0"]),
    ("made available under CC BY 4.0", ["CC-BY-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Released under the MIT License.", ["MIT"]),
    ("MIT License", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0 or the MIT License.", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: MIT/Apache-2.0", ["MIT", "Apache-2.0"]),
    ("// SPDX-License-Identifier: GPL-2.0-only OR (BSD-3-Clause AND Unheard-1.0)", ["GPL-2.0-only", "BSD-3-Clause"]),
    ("The license of the inn was taken away.", []),
    ("Licensed to drive in three countries.", []),
    ("The Apache helicopter needs no license, version 3.", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_wordings(text, want):
    assert [r[3] for r in scan(text)] == want
    assert [r[3] for r in scan("Plain words here. " * 60 + text + "\nMore words. " * 60)] == want


@pytest.mark.parametrize("key", sorted({k for k in WORDING if k[1] == "text"}))
def test_wrapped_texts_in_comments(key):
    body = "\n".join("  * " + line for line in textwrap.wrap(WORDING[key], 70))
    assert [(r[3], r[2], r[7]) for r in scan("int main() { return 0; }\n/*\n" + body + "\n */\nother code = 1;")] == [(key[0], "text", True)]


def test_differences_are_listed():
    row = scan('Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and documentation files (the "Software"), to deal in the Software without restriction')[0]
    assert row[3:] == ("MIT", row[4], "associated", "who is", False) and 0 < row[4] < 1


def naive(text):
    """(license) of every exact run of a template's words that lies in no longer one."""
    words = words_of(text)
    runs = []
    for name, _, wording, _ in TEMPLATES:
        own = words_of(wording)
        runs += [(i, i + len(own), name) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return sorted(name for a, b, name in runs if not any(c <= a and b <= d and d - c > b - a for c, d, _ in runs))


def test_every_row_of_the_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got: dict[int, list] = {}
    for r in licenses(table(spark, SF, "documents")).collect():
        assert r["exact"] and words_of(docs[r["doc_id"]][r["start"] : r["end"]])
        got.setdefault(r["doc_id"], []).append(r["license"])
    want = {d: naive(t) for d, t in docs.items()}
    assert got and {d: sorted(x) for d, x in got.items()} == {d: x for d, x in want.items() if x}


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "Released under the MIT License.", 0), (4, "a\nReleased under the MIT License.", 0), (4, "a\nReleased under the MIT License.", 0), (5, "license " * 20_000, 0)], "doc_id long, text string, start int")
    assert sorted((r["doc_id"] or 0, r["start"], r["license"], r["exact"]) for r in licenses(frame).collect()) == [(0, 0, "MIT", True), (4, 2, "MIT", True), (4, 2, "MIT", True)]
    assert licenses(frame.limit(0)).count() == 0 and licenses(frame, ()).count() == 0


def test_a_long_text_takes_seconds():
    began = time.time()
    text = "".join(f"Line {i}.\nReleased under the MIT License.\n" for i in range(5_000))
    assert len(scan(text)) == 5_000 and time.time() - began < 60


FAMILIES = [
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License.", []),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["CC-BY-3.0"]),
    ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
    ("Licensed under the GPLv3.", ["GPL-3.0"]),
    ("license: LGPLv2.1", ["LGPL-2.1"]),
    ("GNU Affero General Public License v3.0", ["AGPL-3.0"]),
    ("GNU General Public License v2.0", ["GPL-2.0"]),
    ("the license is GNU LGPL v2.1 here", ["LGPL-2.1"]),
    ("Eclipse Public License 2.0", ["EPL-2.0"]),
    ("Boost Software License, Version 1.0", ["BSL-1.0"]),
    ("MIT licensed", ["MIT"]),
    ("Dual licensed under MIT and GPL-2.0", ["MIT", "GPL-2.0"]),
    ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0+"]),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
    ("A license for non-commercial use of GPL 9 engines.", []),
]


@pytest.mark.parametrize("text,want", FAMILIES)
def test_families(text, want):
    assert [r[3] for r in scan(text)] == want
    assert [r[3] for r in scan("Plain words here. " * 60 + text + "\nMore words. " * 60)] == want


SPDX = [
    ("SPDX-License-Identifier: GPL-2.0-only OR (BSD-3-Clause AND Unheard-1.0)", [("spdx", "GPL-2.0-only"), ("spdx", "BSD-3-Clause"), ("unlisted", "Unheard-1.0")]),
    ("SPDX-License-Identifier: LicenseRef-Own-2", [("unlisted", "LicenseRef-Own-2")]),
    ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 and more", [("spdx", "GPL-2.0+")]),
    ("SPDX-License-Identifier: mit or so they say, and apache-2.0 too", [("spdx", "MIT")]),
    ("SPDX-License-Identifier: mit or apache-2.0. Prose follows AND more", [("spdx", "MIT"), ("spdx", "Apache-2.0")]),
    ("SPDX-License-Identifier: MIT/Other-1.1", [("spdx", "MIT"), ("unlisted", "Other-1.1")]),
    ("SPDX-License-Identifier:", []),
]


@pytest.mark.parametrize("text,want", SPDX)
def test_spdx_expressions(spark, text, want):
    assert [(r[2], r[3]) for r in scan(text + "\nplain", unlisted=True)] == want
    rows = scan(text, unlisted=True)
    assert all(text[r[0] : r[1]].lower() == r[3].lower() for r in rows)
    assert [r[3] for r in scan(text)] == [name for kind, name in want if kind == "spdx"]


def test_the_operator_reports_unlisted_identifiers(spark):
    frame = spark.createDataFrame([(1, "# SPDX-License-Identifier: Unheard-1.0"), (2, "x")], "doc_id long, text string")
    assert [(r["doc_id"], r["kind"], r["license"]) for r in licenses(frame).collect()] == [(1, "unlisted", "Unheard-1.0")]


def test_the_winner_saves_most_and_siblings_inside_it_go():
    text = WORDING["BSD-3-Clause", "text"]
    (row,) = scan(text)  # the two-clause text is a prefix of it
    assert row[3] == "BSD-3-Clause" and row[0] == 0 and row[1] >= len(text) - 1
    assert [r[3] for r in scan(WORDING["BSD-2-Clause", "text"])] == ["BSD-2-Clause"]
    both = scan(text + "\n\n" + "plain words here " * 100 + WORDING["BSD-2-Clause", "text"])
    assert [r[3] for r in both] == ["BSD-3-Clause", "BSD-2-Clause"]
