"""Licence scans: known licence sentences, then ordered rules over their identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternion.llm import bytewords

#: Known sentences in normal form, with their identifiers.  ``<v>`` stands for a version number.
SENTENCES = {
    # notices
    "licensed under the apache license, version <v>": "apache-notice",
    'licensed under the apache license, version <v> (the "license")': "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "this work is licensed under the gnu general public license, version <v>": "gpl-notice",
    "licensed under the gnu general public license, version <v>": "gpl-notice",
    "this program is licensed under the gnu general public license version <v>": "gpl-notice",
    "licensed under the gnu lesser general public license, version <v>": "lgpl-notice",
    "licensed under the gnu affero general public license, version <v>": "agpl-notice",
    "licensed under the mozilla public license, version <v>": "mpl-notice",
    "this source code form is subject to the terms of the mozilla public license, v. <v>": "mpl-notice",
    "licensed under the bsd <v>-clause license": "bsd-notice",
    "licensed under the isc license": "isc-notice",
    "licensed under cc by <v>": "cc-by-notice",
    "licensed under cc by-sa <v>": "cc-by-sa-notice",
    "licensed under cc by-nc <v>": "cc-by-nc-notice",
    "licensed under cc by-nd <v>": "cc-by-nd-notice",
    "licensed under cc by-nc-sa <v>": "cc-by-nc-sa-notice",
    "licensed under cc by-nc-nd <v>": "cc-by-nc-nd-notice",
    "licensed under cc0 <v>": "cc0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights",
    # the titles of whole licences
    "apache license version <v>": "apache-title",
    "gnu general public license version <v>": "gpl-title",
    "gnu lesser general public license version <v>": "lgpl-title",
    "gnu affero general public license version <v>": "agpl-title",
    "mozilla public license version <v>": "mpl-title",
    # the parts of whole licences
    'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions': "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement': "mit-warranty",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
}
# the notices of the GNU licences: subject, licence, and whether later versions are meant
for _subject in ("program", "library", "software"):
    for _kind, _name in (("gpl", "general"), ("lgpl", "lesser general"), ("lgpl", "library general"), ("agpl", "affero general")):
        _terms = f"this {_subject} is free software: you can redistribute it and/or modify it under the terms of the gnu {_name} public license"
        for _by in (f"{_terms} as published by the free software foundation", _terms):
            SENTENCES[f"{_by}, either version <v> of the license, or (at your option) any later version"] = f"{_kind}-later"
            SENTENCES[f"{_by}, either version <v>, or (at your option) any later version"] = f"{_kind}-later"
            SENTENCES[f"{_by}, version <v>"] = f"{_kind}-only"
            SENTENCES[f"{_by}, version <v> of the license"] = f"{_kind}-only"

#: Rules in the order in which they are tried, as (licence, identifiers in their order).
#: A licence's ``<v>`` is the version in the sentence that has one.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-notice", "mit-grant", "mit-keep", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-warranty"]),
    ("Apache-<v>", ["apache-notice", "apache-compliance", "apache-copy"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("GPL-<v>-or-later", ["gpl-later"]),
    ("LGPL-<v>-or-later", ["lgpl-later"]),
    ("AGPL-<v>-or-later", ["agpl-later"]),
    ("GPL-<v>-only", ["gpl-only"]),
    ("LGPL-<v>-only", ["lgpl-only"]),
    ("AGPL-<v>-only", ["agpl-only"]),
    ("Apache-<v>", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("GPL-<v>", ["gpl-notice"]),
    ("LGPL-<v>", ["lgpl-notice"]),
    ("AGPL-<v>", ["agpl-notice"]),
    ("MPL-<v>", ["mpl-notice"]),
    ("BSD-<v>-Clause", ["bsd-notice"]),
    ("ISC", ["isc-notice"]),
    ("CC-BY-<v>", ["cc-by-notice"]),
    ("CC-BY-SA-<v>", ["cc-by-sa-notice"]),
    ("CC-BY-NC-<v>", ["cc-by-nc-notice"]),
    ("CC-BY-ND-<v>", ["cc-by-nd-notice"]),
    ("CC-BY-NC-SA-<v>", ["cc-by-nc-sa-notice"]),
    ("CC-BY-NC-ND-<v>", ["cc-by-nc-nd-notice"]),
    ("CC0-<v>", ["cc0-notice"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-<v>", ["apache-title"]),
    ("GPL-<v>", ["gpl-title"]),
    ("LGPL-<v>", ["lgpl-title"]),
    ("AGPL-<v>", ["agpl-title"]),
    ("MPL-<v>", ["mpl-title"]),
    ("All-Rights-Reserved", ["all-rights"]),
]

#: A text without any of these has no known sentence.
_TRIGGERS = (b"licen", b"permission", b"redistribut", b"warrant", b"public domain", b"all rights", b"free software", b"compliance")
_VERSION = re.compile(r"(?<![\w.])[0-9]+(?:\.[0-9]+)*(?![\w]|\.[0-9])")
_LINE = re.compile(r"[^\n]*\n?")
_LEADER = re.compile(r"[ \t]*(?:/\*+|\*+/|\*+|/{2,}|#+|;+|--+|<!--|%+|\"{3}|'{3}|>+|\|+|(?:dnl|rem)(?=[ \t]))*[ \t]*", re.IGNORECASE)
_WORD = re.compile(r"\S+")
_STOP = re.compile(r"[.,;:!?][\"'”’)\]*/_>-]*$")
_OPERAND = r"\(*[A-Za-z0-9.+:-]+\)*"
_SPDX = re.compile(rf"spdx-license-identifier:[ \t]*({_OPERAND}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_OPERAND})*)", re.IGNORECASE)
_EDGE = " \t\r\n\x0b\x0c.,;:!?*#/|-_=~\"'“”‘’()[]<>`"
#: Words of a text that are looked at in one go.
_BLOCK = 1 << 14


def _form(word: str) -> tuple[str, str | None]:
    """A word in normal form (lower case, no signs at its edges, versions as ``<v>``) and the version in it."""
    bare = word.lower().strip(_EDGE).replace("licence", "license")
    version = _VERSION.search(bare) if any(c.isdigit() for c in bare) else None
    return (_VERSION.sub("<v>", bare), version[0]) if version else (bare, None)


def normal(sentence: str) -> tuple[str, ...]:
    """A sentence's normal form: its words in theirs."""
    return tuple(w for w in (x if x == "<v>" else _form(x.replace("<v>", "0"))[0] for x in (y.strip(".,;:()") for y in sentence.split())) if w)


#: The known sentences by their first word, the longest first.
_KNOWN: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _sentence, _identifier in SENTENCES.items():
    _KNOWN.setdefault(normal(_sentence)[0], []).append((normal(_sentence), _identifier))
for _each in _KNOWN.values():
    _each.sort(key=lambda x: -len(x[0]))
_LONGEST = max(len(w) for each in _KNOWN.values() for w, _ in each)


def _words(text: str) -> Iterator[tuple[str, int, int, bool, bool, str | None]]:
    """(form, start, end, whether a sentence may begin, may end here, version) of each word, without comment signs before a line."""
    stopped = True
    for line in _LINE.finditer(text):
        found = list(_WORD.finditer(text, _LEADER.match(text, line.start(), line.end()).end(), line.end()))
        first, last = True, max((i for i, m in enumerate(found) if m[0].strip(_EDGE)), default=-1)
        for i, m in enumerate(found):
            raw = m[0]
            form, version = _form(raw)
            stop = _STOP.search(raw) is not None
            if form:
                yield form, m.start(), m.end(), first or stopped, stop or i == last, version
                first = False
                stopped = stop
            else:
                stopped = stopped or stop


def _hits(text: str) -> list[tuple[int, int, str, str | None]]:
    """(start, end, identifier, version) of the known sentences in a text, in order.

    A known sentence is a run of words, over any number of lines, that begins at the beginning of a
    line or behind a stop and ends at a stop or the end of a line; the longest one counts.
    """
    found: list[tuple[int, int, str, str | None]] = []
    words, more, i = _words(text), True, 0
    held: list = []
    while more or i < len(held):
        if more and len(held) - i < _LONGEST:
            held = [*held[i:], *islice(words, _BLOCK)]
            more, i = len(held) >= _BLOCK, 0
            continue
        step = 1
        if held[i][3]:
            for wanted, identifier in _KNOWN.get(held[i][0], ()):
                n = len(wanted)
                if i + n <= len(held) and held[i + n - 1][4] and all(held[i + k][0] == w for k, w in enumerate(wanted)):
                    found.append((held[i][1], held[i + n - 1][2], identifier, next((x[5] for x in held[i : i + n] if x[5]), None)))
                    step = n
                    break
        i += step
    return found


def _spdx(text: str) -> Iterator[dict]:
    """Whole SPDX expressions; closing brackets that none opens are left out."""
    for m in _SPDX.finditer(text):
        name = m[1]
        while name.endswith(")") and name.count(")") > name.count("("):
            name = name[:-1]
        yield {"license": " ".join(name.split()), "start": m.start(), "end": m.start(1) + len(name), "sentences": ["spdx"]}


def recognise(text: str | None) -> list[dict]:
    """The licences of a text: each rule in order claims its sentences where they follow one another among the known ones."""
    if not text:
        return []
    hits, free = _hits(text), None
    free = [True] * len(hits)
    out = []
    for name, wanted in RULES:
        i = 0
        while i < len(hits):
            at, k = [], i
            for identifier in wanted:
                while k < len(hits) and not (free[k] and hits[k][2] == identifier):
                    k += 1
                if k == len(hits):
                    break
                at.append(k)
                k += 1
            if len(at) < len(wanted):
                break
            for k in at:
                free[k] = False
            version = next((hits[k][3] for k in at if hits[k][3]), None)
            out.append({"license": name.replace("<v>", version or "unknown"), "start": hits[at[0]][0], "end": hits[at[-1]][1], "sentences": [hits[k][2] for k in at]})
            i = at[0] + 1
    out += _spdx(text)
    return sorted(out, key=lambda x: (x["start"], x["license"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, start, end, sentences) for every licence found in the whole texts.

    ``start`` and ``end`` are places in code points; ``sentences`` the identifiers that the rule
    matched.  A statement that occurs twice in a text is two rows; an SPDX
    expression is one, as it is written.  Very long texts are read in blocks of words.  Null and empty texts have none;
    repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    No data moves between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch, "text"):
                data, at = bytewords.buffer(part.column("text"))
                raw = data.tobytes()
                low, ids, rows = raw.lower(), part.column("id").to_pylist(), []
                if any(t in low for t in _TRIGGERS):
                    for i in range(part.num_rows):
                        own = low[at[i] : at[i + 1]]
                        if any(t in own for t in _TRIGGERS):
                            rows += [{"id": ids[i], **x} for x in recognise(raw[at[i] : at[i + 1]].decode())]
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return bytewords.mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, license string, start long, end long, sentences array<string>")


_FOUND = pa.schema([("id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))])
