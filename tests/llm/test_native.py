"""URL filters, mixing, sharding and decontamination."""

import re
import zlib

import pytest
from cases import docs, empty, prose, rows, with_extra

from ternion.llm import decontaminate, mixing, sharding, urls

URLS = [
    (1, "http://a.example.com/en/7?x"),
    (2, "https://EXAMPLE.com/en/8"),
    (3, "https://badexample.com/en/7"),
    (4, "example.com/en/7"),
    (5, None),
    (6, ""),
    (7, "x://com/en/#f"),
    (8, "x://net"),
    (9, "x://a.b.example.net/de/8"),
    (10, "x://a.net?/de/"),
    (11, "x://org/es/" + "y" * 5000),
    (12, "x://com./en/"),
    (13, "x://a..com/en/"),
    (13, "x://user@q.com:80/en/"),
    (None, "x://y.com/en/"),
    (1, "http://a.example.com/en/7?x"),
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


@pytest.mark.parametrize("extra", [False, True])
def test_urls(spark, extra):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    if extra:
        pages = with_extra(pages.withColumnRenamed("url", "u")).drop("url").withColumnRenamed("u", "url")
    got = sorted((str(r.id), r.host, r.path, str(r.rule), r.verdict) for r in urls.judge(pages).collect())
    assert got == sorted((str(i), h, p, str(r), v) for i, u in URLS for h, p, r, v in [judged(u)])
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}
    ties = [("allow", "com", "/en/"), ("block", "com", "/en/")]
    assert {r.verdict for r in urls.judge(pages.filter("page_id = 7"), ties).collect()} == {"block"}


def test_url_rules_of_contract(spark):
    """The production rules word by word, as the contract lists them."""
    want = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    pages = spark.createDataFrame([(f"{h}{p}", f"x://{h}{p}") for h, p in want], "page_id string, url string")
    assert {(r.id, r.rule): r.verdict for r in urls.judge(pages).collect()} == {(f"{h}{p}", f"{h}{p}"): v for (h, p), v in want.items()}


def shares(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        unit = left / (sum(weight[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and unit * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else unit * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("extra", [False, True])
def test_mix(spark, extra):
    got = mixing.mix(docs(spark, extra)).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows())
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    goal, taken = shares(sizes), {}
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert {s: int(g + 1e-9) for s, g in goal.items()} == taken
    again = mixing.mix(docs(spark, extra).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_mixed_rows(spark, extra):
    given = docs(spark, extra)
    out = mixing.mixed(given)
    assert out.columns == given.columns
    taken = {}
    for r in mixing.mix(given).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    words = {}
    texts = {(r[0], r[3]): r[1] for r in rows()}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.encode().split())
        if r.doc_id not in (14, 15):
            assert texts[r.doc_id, r.source].startswith(r.text)
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mixed(empty(spark)).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_shard(spark, extra):
    got = sharding.shard(docs(spark, extra), 8).collect()
    sizes = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((str(r.id), r.size, r.text_crc32) for r in got) == sizes
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_are_even_and_stable(spark):
    frame = spark.range(20000).selectExpr("id doc_id", "'' text")
    got = {r.id: r for r in sharding.shard(frame, 10).collect()}
    counts = [sum(r.shard == s for r in got.values()) for s in range(10)]
    assert min(counts) > 1800 and max(counts) < 2200
    more = {r.id: r.shard for r in sharding.shard(frame, 11).collect()}
    assert all(more[i] == r.grown_shard for i, r in got.items())
    heavy = [r.shard for r in sharding.shard(frame, [3, 1, 0]).collect()]
    assert 14500 < heavy.count(0) < 15500 and heavy.count(2) == 0
    with pytest.raises(ValueError):
        sharding.shard(frame, [])


BENCH = "item_id long, text string"


def test_decontaminate(spark):
    item = "Then a train goes 60 km in 2 hours and then uncle Bob rides 60 km back home again today."
    filler = prose(1, 50)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, prose(2, 30)), (5, "only three words"), (5, "only three words"), (6, "12 13 14 15 16 17")], BENCH)
    given = [
        (1, f"{filler}. {item} {filler}"),
        (2, f"{filler}. {item.replace('60', '75').replace('2', '3').replace('Bob', 'Tom')}"),
        (3, item.replace("60 km in", "11 km in").replace("2", "4") + " " + filler),
        (4, f"{filler} {prose(2, 30).upper()} {filler}"),
        (5, " ".join(prose(2, 30).split()[:15])),
        (6, None),
        (7, ""),
        (None, item),
        (9, "these only three words match"),
        (10, "12 13 14 15 16 17"),
        (1, f"{filler}. {item} {filler}"),
    ]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    got = {(r.id, r.item): r for r in decontaminate.contaminated(with_extra(frame), with_extra(bench)).collect()}
    assert got.keys() == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 1), (9, 5)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[2, 1].slot_agreement == 1 > got[3, 1].slot_agreement
    kept = decontaminate.clean(with_extra(frame), bench)
    assert kept.columns == with_extra(frame).columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 10]
    nothing = decontaminate.contaminated(frame, bench.limit(0))
    assert nothing.count() == 0 and decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_decontaminate_inconsistent_slots(spark):
    item = "If 7 cats and 7 dogs meet 7 birds near 7 trees then 7 owls and 7 bats will sing all night"
    frame = spark.createDataFrame([(1, item.replace("7", "9")), (2, "If 1 cats and 2 dogs meet 3 birds near 4 trees then 5 owls and 6 bats will sing all night")], "doc_id long, text string")
    other = "A coach with 60 red seats and 2 doors drives 90 long miles with 5 old men on board today"
    frame = frame.union(spark.createDataFrame([(3, re.sub("[0-9]+", "7", other)), (4, other.replace("60", "61").replace("90", "91"))], "doc_id long, text string"))
    got = decontaminate.contaminated(frame, spark.createDataFrame([(1, item), (2, other)], BENCH)).collect()
    assert sorted((r.id, r.item, r.verbatim) for r in got) == [(1, 1, False), (4, 2, False)]


def test_decontaminate_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    text = prose(2, 30)
    frame = spark.createDataFrame([(1, f"x {text} y"), (2, prose(3, 40))], "doc_id long, text string")
    assert [r.id for r in decontaminate.contaminated(frame, spark.createDataFrame([(1, text)], BENCH)).collect()] == [1]


def test_decontaminate_whatever_stands_around(spark):
    """Short items behind a colon, lower-cased or wrapped ones, and ones with another name at a sentence's start."""
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Alice gave seven red apples to Bob and Carol near Paris yesterday"), (3, "Maria sold every old boat")], BENCH)
    given = [
        (1, "Question: What is the capital of France?"),
        (2, "so alice gave seven red apples to bob and carol near paris yesterday evening"),
        (3, "Then Alice gave seven red apples to\nBob and\nCarol near\nParis yesterday."),
        (4, "Later, Peter sold every old boat."),
        (5, "Berlin is the capital of Germany. It lies on a river."),
        (6, prose(3, 40)),
        (7, "WHAT IS THE CAPITAL OF FRANCE?"),
        (8, "Question: What is the capital of Spain?"),
    ]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    got = {(r.id, r.item) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 3), (7, 1), (8, 1)}
