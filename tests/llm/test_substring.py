import numpy as np
import pyarrow as pa
import pytest
from cases import docs, empty, prose, rows

from ternion.llm import bytewords, substring


def plain(given, n=13):
    """(id, words, removed, kept) of each row, word by word."""
    first = {}
    texts = [(r[0], (r[1] or "").encode().split()) for r in given]
    for i, w in texts:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((str(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize(("extra", "bucket"), [(False, 4 << 20), (True, 3000)])
def test_against_word_by_word(spark, extra, bucket):
    got = substring.remove_repeats(docs(spark, extra), bucket_bytes=bucket).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept) for r in got) == plain(rows())


def test_spans_and_other_lengths(spark):
    shared = prose(9, 60)
    given = [(1, "begin " + shared, "", "", 0), (2, f"x y {shared} z", "", "", 0), (3, prose(10, 5), "", "", 0)]
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n long")
    got = {r.id: r for r in substring.remove_repeats(frame, 20).collect()}
    assert got[2].kept == "x y z" and [(s.first, s.end) for s in got[2].spans] == [(2, 62)]
    assert got[1].n_removed == 0
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame, 7).collect()) == plain(given, 7)


def test_empty(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_longest_repeats(spark):
    shared = prose(9, 60)
    frame = spark.createDataFrame([(1, "a " + shared), (2, "b " + shared), (3, "c " + " ".join(shared.split()[:30])), (4, None)], "doc_id long, text string")
    got = {r.id: r.longest for r in substring.longest_repeats(frame).collect()}
    assert got == {1: 52, 2: 52, 3: 26, 4: 0}


def test_levels():
    assert [substring.repeated_levels(n) for n in (1, 4, 5, 7, 13, 20)] == [[1], [4], [4, 5], [4, 7], [4, 8, 13], [4, 8, 16, 20]]


@pytest.mark.parametrize("n", [1, 3, 8, 13, 33])
def test_sums_against_term_by_term(n):
    values = np.random.default_rng(n).integers(0, 1 << 63, 50, np.uint64)
    step = 0xD6E8FEB86659FD93
    plainly = [sum(int(values[i + j]) * step**j for j in range(n)) % (1 << 64) for i in range(51 - n)]
    assert bytewords._sums(values, n, np.uint64(step)).tolist() == plainly


def test_windows_of_one_hash_are_told_apart():
    """Windows that agree in the 64 bits, but not in the check, are different ones."""
    h, c, d = np.array([5, 5, 5, 7], np.uint64), np.array([2, 1, 2, 1]), np.array([10, 20, 30, 40])
    hashes, checks, least, many = substring._grouped([h[:2], h[2:]], [c[:2], c[2:]], [d[:2], d[2:]])
    assert hashes.tolist() == [5, 5, 7] and checks.tolist() == [1, 2, 1]
    assert least.tolist() == [20, 10, 40] and many.tolist() == [False, True, False]
    told = (np.array([5, 5, 7], np.uint64), np.array([1, 2, 1]), np.array([20, 10, 40]))
    asked = np.array([5, 5, 5, 6, 7, 7, 9], np.uint64), np.array([1, 2, 3, 1, 1, 2, 1])
    assert substring._firsts(*asked, told, -1).tolist() == [20, 10, -1, -1, 40, -1, -1]


def test_clashing_hashes_are_told_apart(spark, monkeypatch):
    """With hashes of three bits almost all windows clash; only the check tells them apart."""
    real = bytewords.window_hashes

    def few(hashed, row, k):
        found, inside = real(hashed, row, k)
        return found & np.uint64(7), inside

    levels, texts = [4, 8, 13], [prose(s, 60) for s in (20, 21)] + [prose(20, 60)[30:]]
    monkeypatch.setattr(bytewords, "window_hashes", few)
    table = pa.table({"id": pa.array([1, 2, 3]), "text": texts, "bucket": pa.array([0, 0, 0])})
    asked = None
    for level in range(3):
        asked = substring._asks(levels, level, level == 2)(table, asked)
    windows = {tuple(t.split()[i : i + 13]) for t in texts for i in range(len(t.split()) - 12)}
    assert asked.num_rows == len(windows)


def test_many_repeated_rows(spark):
    """A passage in every document and rows that are equal in all columns."""
    shared = prose(9, 40)
    given = [(i, f"{prose(500 + i, 8)} {shared}") for i in range(300)] + [(1000, shared)] * 300
    frame = spark.createDataFrame(given, "doc_id long, text string")
    got = substring.remove_repeats(frame, bucket_bytes=20000).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept) for r in got) == plain(given)
