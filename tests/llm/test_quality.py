import numpy as np
import pytest
from cases import WORDS, docs, empty, prose, with_extra

from ternion.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    """Good prose, junk, and toxic prose, with their labels."""
    texts, labels = [], []
    for i in range(n):
        text = prose(i, 40 + i % 60)
        kind = i % 4
        if kind == 2:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 3:
            words = text.split()
            text = " ".join(w if j % 9 else ["moron", "scum", "trash"][j // 9 % 3] for j, w in enumerate(words))
        texts.append((i, text, "en", "abcd"[i % 4] if i % 3 else "e", len(text)))
        labels.append((i, int(kind != 2), int(kind == 3)))
    return texts, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("extra", [False, True])
def test_held_out(spark, extra):
    texts, labels = corpus()
    frame = spark.createDataFrame(texts, SCHEMA)
    frame = with_extra(frame) if extra else frame
    out = quality.kept(frame, spark.createDataFrame(labels[:120], LABELS))
    assert out.columns == frame.columns
    kept = {r.doc_id for r in out.collect()}
    held_out = range(120, 240)
    assert np.mean([i in kept for i in held_out if i % 4 < 2]) > 0.95
    assert np.mean([i in kept for i in held_out if i % 4 >= 2]) < 0.1


def test_lexicon_is_learned(spark):
    texts, labels = corpus()
    found = quality.train(spark.createDataFrame(texts, SCHEMA), spark.createDataFrame(labels, LABELS))
    assert {b"moron", b"scum", b"trash"} <= set(found.words) and not {w.encode() for w in WORDS} & set(found.words)


def test_sites_shrink(spark):
    """Posteriors as computed in plain Python; a site of one document stays near its host, a large one goes its own way."""
    rows = [("h", "p", 0.9)] * 400 + [("h", "q", 0.1)] * 400 + [("h", "r", 0.1), ("i", "p", 0.2), (None, None, 0.5)]
    site, mu = quality.sites(spark.createDataFrame(rows, "host string, path string, p double"))
    assert mu == pytest.approx(sum(r[2] for r in rows) / len(rows))
    by = {(r.s_host, r.s_path): r for r in site.collect()}
    assert by.keys() == {("h", "p"), ("h", "q"), ("h", "r"), ("i", "p"), (None, None)}
    one = by["h", "r"]
    post = lambda r: (r.s_sum + r.s_strength * r.host_posterior) / (r.s_n + r.s_strength)
    assert abs(post(by["h", "p"]) - 0.9) < 0.02 and abs(post(by["h", "q"]) - 0.1) < 0.02
    assert abs(post(one) - 0.1) > 0.05


def test_cases(spark):
    given = docs(spark, True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 0, 1), (3, None, None), (999, 1, 1)], LABELS)
    out = quality.kept(given, labels, columns=["posterior"])
    assert set(out.columns) == set(given.columns)
    assert all(0 <= r.posterior <= 1 for r in out.collect())
    none = labels.limit(0)
    assert quality.kept(given, none).count() == given.count()
    assert quality.kept(empty(spark), labels).count() == 0
