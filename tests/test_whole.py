"""Queries over whole tables against their SQL: rows of every single rule, and others that must not be empty."""

import glob
import os

import pytest

from ternion import queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["not_exists", "reason_same_as", "range_scan", "path_plus_cycle", *queries.RULE_QUERIES])
def test_whole_tables(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SMALL).select(*columns)
    rows = want.fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows) and rows


@pytest.mark.parametrize("suffix", ["nt", "ttl"])
def test_blank_nodes_of_files(spark, tmp_path, suffix):
    """The same label in two files is two nodes; parts of one write are one document."""
    from ternion.sources import io

    (tmp_path / f"a.{suffix}").write_text('_:x <http://e/p> "1" .\n')
    (tmp_path / f"b.{suffix}").write_text('_:x <http://e/q> "2" .\n')
    loaded = io.load(spark, str(tmp_path), "ntriples" if suffix == "nt" else "turtle")
    assert loaded.select("s").distinct().count() == loaded.count() == 2
    if suffix == "nt":
        for n, p in ((0, "p"), (1, "q")):
            (tmp_path / "out").mkdir(exist_ok=True)
            (tmp_path / "out" / f"part-0000{n}-ab-c000.txt").write_text(f'_:x <http://e/{p}> "1" .\n')
        assert io.load(spark, str(tmp_path / "out"), "ntriples").select("s").distinct().count() == 1
