import random

import corpus_pipeline
import pytest
from cases import docs, empty, prose, rows

from ternion.llm import jaccard, simhash
from ternion.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components_of(sets):
    """Least index of each set's component, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(seed, n, edits):
    words = [f"w{random.Random(seed * 1000 + i).randrange(10_000)}" for i in range(n)]
    rng = random.Random(seed * 77 + edits)
    for at in rng.sample(range(n), edits):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("extra", [False, True])
def test_against_all_pairs(spark, extra):
    given = docs(spark, extra)
    found = components_of([plain(r[1]) for r in rows()])
    least = {}
    for r, g in zip(rows(), found):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted((str(r[0]), str(least.get(g))) for r, g in zip(rows(), found))
    assert sorted((str(r.id), str(r.component_id)) for r in jaccard.near_duplicates(given).collect()) == want
    kept = jaccard.representatives(given)
    assert kept.columns == given.columns and kept.count() == len(set(found))
    assert jaccard.representatives(empty(spark)).count() == 0


def test_pipeline_links_edited_copies(spark):
    """Copies with some words changed differ in more than 3 SimHash bits; the stage keeps one of each group."""
    given = [(10 * s + e, edited(s, 150, e), "en", "a", 1) for s in range(8) for e in (0, 1, 2, 3)] + [(1000, prose(9, 40), "en", "a", 1)]
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    sets = components_of([plain(t) for _, t, *_ in given])
    kept = corpus_pipeline.deduplicate(spark, frame, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({given[g][0] for g in sets})
    assert len(kept) < 20


def test_pipeline_uses_the_simhash_index(spark):
    """Two texts of similarity 0.8 and 3 SimHash bits that share no min-hash band are found by the index; far ones it finds are verified."""
    words = "w84492 w76137 w20135 w77858 w21115 w59338 w86514 w32427 w32137 w94268 w94208 w97324"
    texts = [f"{words} w43078", f"{words} w17847", f"{words} w43078 {words} w43078", prose(9, 40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert components_of([plain(t) for t in texts]) == [0, 0, 2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, frame, "").collect()) == [0, 2, 3]


def test_index_alone(spark):
    """The index's candidates join texts of one SimHash and of up to BITS bits that share three bytes of one half."""
    long = prose(11, 2000)
    texts = [edited(s, 300, e) for s in range(6) for e in (0, 1, 2, 8)] + [long, long + " x", "one two", "One  two", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").fillna("").selectExpr("id", "xxhash64(text) text_hash", "text")
    each = jaccard._classes(frame.coalesce(1), 5).cache()
    at = {r.cls: (r.id, r.fp & (1 << 64) - 1) for r in each.collect() if r.fp is not None}
    assert len(at) == 27 and all(fp == simhash.fingerprint(texts[i], 5) for i, fp in at.values())
    assert at[each.filter("id = 24").first().cls][1] == at[each.filter("id = 25").first().cls][1]

    def near(x, y):
        same = [(x ^ y) >> 8 * p & 255 == 0 for p in range(8)]
        return (x ^ y).bit_count() <= jaccard.BITS and max(sum(same[:4]), sum(same[4:])) >= 3

    want = {(a, b) for a in at for b in at if a < b and near(at[a][1], at[b][1])}
    pairs = {(r.a, r.b) for r in jaccard._indexed(each, 0.0).collect()}
    assert pairs <= want and any((at[a][1] ^ at[b][1]).bit_count() > simhash.MOST_BITS for a, b in pairs)
    roots = [{r.node: r.root for r in components(spark.createDataFrame(sorted(p), "a long, b long")).collect()} for p in (pairs, want)]
    assert roots[0] == roots[1]
