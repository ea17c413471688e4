"""The pipeline against its stages' own definitions, and the registered queries."""

import corpus_pipeline
import pytest
from cases import docs

import __spark_entry__

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables in which every stage has something to do."""
    path = tmp_path_factory.mktemp("tables")
    item = docs(spark).filter("doc_id = 100").first().text
    docs(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = frame.columns, [frame.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = stage(spark, frame, folder)
        if name != "sharding":
            assert frame.columns == columns
        counts.append(frame.count())
    assert counts[0] == counts[1] > counts[2] > counts[3]
    assert counts[5] == before.count()
    # the item's document and its copies by the same words are gone
    assert not [r for r in before.collect() if r.text == docs(spark).filter("doc_id = 100").first().text]
    assert corpus_pipeline.run(spark, folder).count() == counts[5]


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op7_urls", "op8_mixing"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, TINY)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
