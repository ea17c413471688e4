import random
import re
import textwrap

import pytest
from cases import docs, empty, prose, with_extra

from ternion.llm import licenses

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def wrapped(width):
    return textwrap.fill(" ".join(MIT.split()[2:]), width, break_long_words=False, break_on_hyphens=False)


def leading(sign, text):
    return "\n".join(sign + line for line in text.split("\n"))


CASES = [
    (f"{prose(1, 20)}\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Text. Released under the MIT License. More text.", ["MIT"]),
    ("This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", ["GPL-3", "CC-BY-NC-4.0"]),
    (f"/* {MIT} */", ["MIT"]),
    ("# SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("Licensed under the Apache Licence, version 2.0!\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "Apache-2.0"]),
    (leading("# ", wrapped(40)), ["MIT"]),
    ("/*\n" + leading(" * ", wrapped(33)) + "\n */", ["MIT"]),
    (leading("// ", wrapped(200)), ["MIT"]),
    ("Words. " + wrapped(12).replace("\n", "\n\n"), ["MIT"]),
    ("  x GNU GENERAL PUBLIC LICENSE", []),
    ("        GNU GENERAL PUBLIC LICENSE\n           Version 3, 29 June 2007\n\n Copyright", ["GPL-3"]),
    (" * SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR MIT */", ["(GPL-2.0 WITH Linux-syscall-note) OR MIT"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0\nand more", ["MIT OR Apache-2.0"]),
    ("This library is free software; you can redistribute it and/or modify it\n# under the terms of the GNU Lesser General Public License as published by\n# the Free Software Foundation; either version 2.1 of the License, or (at\n# your option) any later version.", ["LGPL-2.1-or-later"]),
    ("He was licensed under the old law and had permission.", []),
    ("The Apache License is long.", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_recognise(text, want):
    assert [x["license"] for x in licenses.recognise(text)] == want


def test_places():
    text = "Ünïcödé first.\nReleased under the MIT License.\nend"
    (hit,) = licenses.recognise(text)
    assert text[hit["start"] : hit["end"]] == "Released under the MIT License."


def test_every_sentence_and_rule():
    """Each known sentence alone gets the licence of the first rule that it satisfies."""
    for sentence, identifier in licenses.SENTENCES.items():
        plain = [x for x in licenses.recognise(sentence.replace("<v>", "4.0") + ".")]
        rule = next((name for name, wanted in licenses.RULES if wanted == [identifier]), None)
        assert [x["license"] for x in plain] == ([rule.replace("<v>", "4.0")] if rule else [])


def test_long_text_is_linear():
    assert licenses.recognise("licensed " + "x. " * 50_000) == []


@pytest.mark.parametrize("extra", [False, True])
def test_scan(spark, extra):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(None, CASES[0][0]), (0, CASES[0][0])], "doc_id long, text string")
    got = sorted((str(r.id), r.license) for r in licenses.scan(with_extra(frame) if extra else frame).collect())
    want = [(str(i), name) for i, (_, names) in enumerate(CASES) for name in names]
    assert got == sorted([*want, ("None", "Apache-2.0"), ("0", "Apache-2.0")])
    assert licenses.scan(docs(spark)).count() == licenses.scan(empty(spark)).count() == 0


def test_against_plain():
    """Known sentences among other words, wrapped anywhere and behind comment signs, against a search in bare words."""
    rng, known = random.Random(5), list(licenses.SENTENCES)
    bare = lambda text: " ".join(w for w in (x.lower().strip(licenses._EDGE) for x in text.split()) if w)
    for _ in range(60):
        chosen = [rng.choice(known).replace("<v>", "2.1") for _ in range(3)]
        text = ". ".join(f"{prose(rng.randrange(99), 5)}. {c}" for c in chosen) + "."
        found = [bare(re.sub(r"\n(?:# )?", " ", s)) for s in (text[a:b] for a, b, *_ in licenses._hits(text))]
        assert found == [bare(c) for c in chosen]
        lines = leading(rng.choice(["", "# ", " * ", "// "]), textwrap.fill(text, rng.randrange(20, 90), break_long_words=False, break_on_hyphens=False))
        assert [x[2] for x in licenses._hits(lines)] == [x[2] for x in licenses._hits(text)]


def test_very_long_text():
    text = "plain words here. " * 300_000 + wrapped(30) + " end" * 100_000
    assert [x["license"] for x in licenses.recognise(text)] == ["MIT"]
