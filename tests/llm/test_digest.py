import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from cases import docs, empty, prose, rows

from ternion.llm import digest


def test_entropy():
    data = np.frombuffer(prose(1, 80).encode(), np.uint8)
    bins = digest.entropy_bins(data)
    assert len(bins) == len(data) - digest.WINDOW + 1
    for i in range(0, len(bins), 11):
        counts = Counter(data[i : i + digest.WINDOW].tolist()).values()
        plain = -sum(c / digest.WINDOW * math.log2(c / digest.WINDOW) for c in counts)
        assert abs(bins[i] - plain * digest.STEPS) <= 0.51


def edited(given):
    order = sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for a, b in zip(order, [*order[1:], order[0]]):
        x, y = a[1] or "", b[1] or ""
        q = len(x) // 4
        out.append((str(a[0]), len(x), hashlib.sha256((x[: len(x) - q] + y[:q]).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("extra", "size"), [(False, 8 << 20), (True, 5000)])
def test_edit_probe(spark, extra, size):
    got = digest.edit_probe(docs(spark, extra), range_bytes=size).collect()
    assert sorted((str(r.id), r.n_chars, r.edited_sha256) for r in got) == edited(rows())
    by_text = {}
    for r in got:
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    for r in digest.fingerprints(docs(spark)).join(docs(spark).withColumnRenamed("doc_id", "id"), "id").collect():
        if r.id not in (14, 15):
            assert by_text.setdefault(r.text or "", r.fingerprint) == r.fingerprint


def test_alike_and_different(spark):
    given = [(i, prose(i, 400)) for i in range(30)]
    got = digest.edit_probe(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert min(r.near_edited for r in got) > 0.4
    assert np.median([r.near_next for r in got]) < 0.2


def test_likeness():
    none, some = np.zeros((0, 256), np.uint8), np.packbits(np.random.default_rng(1).random((2, 2048)) < 0.2, axis=1)
    assert digest.likeness(none, none) == 1 and digest.likeness(none, some) == 0 and digest.likeness(some, some) == 1
    other = np.packbits(np.random.default_rng(2).random((3, 2048)) < 0.2, axis=1)
    assert digest.likeness(some, other) == digest.likeness(other, some) < 0.1


def test_few(spark):
    assert digest.edit_probe(empty(spark)).count() == 0
    one = digest.edit_probe(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert [(r.id, r.edited_sha256, r.near_next) for r in one] == [(5, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
