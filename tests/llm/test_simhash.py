import numpy as np
import pytest
import xxhash
from cases import docs, empty, rows
from conftest import TINY

from ternion.llm import components as components_module
from ternion.llm import queries, simhash
from ternion.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def groups(fps):
    """Least id of each row's component, by comparing all pairs."""
    ids = list(range(len(fps)))

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("extra", [False, True])
def test_against_all_pairs(spark, extra):
    given = rows()
    fps = [plain(r[1]) for r in given]
    root = groups(fps)
    least = {}
    for r, g in zip(given, root):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted((str(r[0]), fp, str(least.get(g))) for r, fp, g in zip(given, fps, root))
    got = sorted((str(r.id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in simhash.near_duplicates(docs(spark, extra)).collect())
    assert got == want


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, what is saved of few rows has a file for each core at most."""
    files, given = [], simhash.saved

    def counted(df, name):
        out = given(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    for module in (simhash, components_module):
        monkeypatch.setattr(module, "saved", counted)
    wide = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        got = sorted((str(r.id), str(r.component_id)) for r in simhash.near_duplicates(docs(spark).coalesce(2)).collect())
        parts = queries.op2_simhash(spark, TINY).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((str(r.id), str(r.component_id)) for r in simhash.near_duplicates(docs(spark)).collect())
    assert {name for name, _ in files} == {"fingerprints", "classes", "postings", "edges", "roots"}
    assert max(parts, *(n for _, n in files)) <= spark.sparkContext.defaultParallelism, (parts, files)


def test_fingerprint_of_short_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint("a b c") == simhash.fingerprint("A  B\tC")


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.representatives(empty(spark)).count() == 0


def test_overfull_buckets_lose_no_link(spark, monkeypatch):
    """Keys beyond the bucket size go through finer keys and midpoints, with the same components."""
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    while len(fps) < 120:  # a chain of small steps, and noise far away
        x = int(rng.choice(list(fps)))
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    root = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(frame)).collect()}
    got = [root.get(f, f) for f in fps]
    want = groups(fps)
    assert [[i for i, x in enumerate(got) if x == g] for g in got] == [[i for i, x in enumerate(want) if x == g] for g in want]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (9, 9), (200, 200), (5, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_representatives(spark, extra):
    given = docs(spark, extra)
    kept = simhash.representatives(given)
    assert kept.columns == given.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got))
    fps = [plain(t) for _, t in got]
    assert len(set(groups(fps))) == len({g for g in groups([plain(r[1]) for r in rows()])})
    assert (1, rows()[0][1]) in got and 2 not in {i for i, _ in got}
