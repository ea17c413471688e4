import random
import math
import re

import pytest
from cases import docs, empty, prose, with_extra

from ternion.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_against_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@.-_+ 12345678905()é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "x 255.255.0.1.7", "+1 (663) 555-6869 z", "a@b.c@d.e", "é@b.co", "00255.1.1.1", "a@b.c._d@e.f"):
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    text = "a" * 400_000 + " " + "1" * 400_000 + "+1" + "(" * 300_000
    assert pii.base_spans(text) == []


ROWS = [
    (1, "call Zorblax Quimby now at zorb@x.com today please"),
    (2, "we met Zorblax Quimby once zorb@x.com was there ok"),
    (3, "the cat sat with friends at home now and then today"),
    (4, "mail Zorblax about zorb@x.com later"),
    (5, None),
    (None, ""),
    (7, "the call was now at home today ok we met there please"),
    (8, "Ünïcödé Zorblax was here"),
    (8, "Ünïcödé Zorblax was here"),
]


def revealed(given):
    """Spans of revealing terms, by counting in plain Python."""
    word = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    met, seen, whole, texts = {}, {}, {}, {text or "" for _, text in given}
    for text in texts:
        tokens = [(m.start(), m.end(), lower(m[0])) for m in word.finditer(text)]
        for t in {t for _, _, t in tokens}:
            seen[t] = seen.get(t, 0) + 1
        for kind, s, e in plain(text):
            whole.setdefault((kind, text[s:e].lower()), set()).add(text)
            left = [t for _, b, t in tokens if b <= s][-5:]
            right = [t for a, _, t in tokens if a >= e][:5]
            for t in {*left, *right}:
                met.setdefault((kind, text[s:e].lower(), t), set()).add(text)
    share = lambda k, c: 1 - math.log2(seen[k[2]] / len(c)) / math.log2((len(texts) + 1) / len(whole[k[:2]]))
    telling = {k[2] for k, c in met.items() if len(c) >= 2 and seen[k[2]] <= 2 * len(c) and share(k, c) >= 0.5}
    out = []
    for i, text in given:
        base = plain(text or "")
        out.append((str(i), sorted((m.start(), m.end()) for m in word.finditer(text or "") if lower(m[0]) in telling and not any(a < m.end() and m.start() < b for _, a, b in base))))
    return sorted(out)


@pytest.mark.parametrize("extra", [False, True])
def test_revealing_terms(spark, extra):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    frame = with_extra(frame) if extra else frame
    got = pii.find(frame).collect()
    assert sorted((str(r.id), [(x.start, x.end) for x in r.terms]) for r in got) == revealed(ROWS)
    assert any(r.terms for r in got)
    clean = pii.sanitise(frame)
    assert clean.columns == frame.columns
    texts = sorted((str(r.doc_id), str(r.text)) for r in clean.collect())
    assert ("1", "call   now at [EMAIL] today please") in texts and ("5", "None") in texts and len(texts) == len(ROWS)


def test_copies_reveal_nothing(spark):
    frame = spark.createDataFrame([(i, "ask Quimby at q@x.org soon") for i in range(5)], "doc_id long, text string")
    assert not any(r.terms for r in pii.find(frame).collect())


def test_generalised(spark):
    given = [(i, f"{prose(i, 3)} Hub u{i % 3}@x.org {prose(i + 50, 3)}") for i in range(12)]
    got = pii.find(spark.createDataFrame(given, "doc_id long, text string")).collect()
    kinds = {x.kind for r in got for x in r.terms if given[r.id][1][x.start : x.end] == "Hub"}
    assert kinds == {"generalise"} or kinds == set()


@pytest.mark.parametrize("extra", [False, True])
def test_cases(spark, extra):
    assert pii.find(docs(spark, extra)).count() == docs(spark).count()
    assert pii.find(empty(spark)).count() == 0


def _telling(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.id][x.start : x.end] for r in pii.find(frame).collect() for x in r.terms}


def test_copies_hide_nothing(spark):
    """Copies count on neither side, and a line with the same words around the entity meets it in each text."""
    copied = ["see Quimby near q@x.org soon"] * 100 + ["old Quimby wrote q@x.org once", "now Quimby asks q@x.org again"]
    assert "Quimby" in _telling(spark, copied)
    signed = [f"{prose(i, 12)} yours truly from dear Blorptag b@x.org best wishes to all there" for i in range(6)]
    assert "Blorptag" in _telling(spark, signed)
    assert "Grumph" not in _telling(spark, ["a Grumph b@x.org", "c Grumph b@x.org", *(f"{prose(i, 9)} Grumph" for i in range(9))])


def test_one_text_reveals_nothing(spark):
    """Two contexts in a single text are one meeting; a word beside an entity that most texts have tells little."""
    assert not _telling(spark, ["Zorblat a@x.org one two three four five six Zorblat writes to a@x.org again"])
    common = [f"{prose(i, 3)} Wibble all@x.org {prose(i + 40, 4)}" for i in range(4)] + [f"{prose(i, 5)} all@x.org" for i in range(60, 66)] + [f"{prose(90 + i, 9)} Wibble" for i in range(2)]
    assert "Wibble" not in _telling(spark, common)


def test_ip_part_of_many_zeros():
    text = "0" * 5000 + ".1.2.3"
    assert pii.base_spans(text)[0] == (1, 0, len(text))
