"""The catalogue engine: golden cases, and every query with a SQL twin against DuckDB at the smallest scale."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from lodestone.functions import text
from lodestone.operators import paths, search
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
RECORD = "uid long, device_id string, record_idx long, parent_idx long, name string, size long, mtime long, is_dir boolean, is_symlink boolean"


def catalog(spark, rows):
    df = spark.createDataFrame([(1, *r, False) for r in rows], RECORD)
    return df.withColumn("name_lc", text.ascii_lower("name"))


def plain(v):
    if isinstance(v, Decimal):
        return int(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = registry.QUERIES[name](spark, SF)
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(out.columns)
    want = Counter(tuple(map(plain, r)) for r in cursor.fetchall())
    assert Counter(tuple(map(plain, r)) for r in out.select(*columns).collect()) == want


def test_ascii_folding_only(spark):
    r = catalog(spark, [("d", 0, None, "Café", 1, 1, False), ("d", 1, None, "CAFÉ", 1, 1, False)])
    assert [x.name for x in search.matching(r, "CAFé", 1).collect()] == ["Café"]
    assert search.matching(r, "", 1).count() == 2
    assert search.matching(r, "", 2).count() == 0


def test_tokens():
    assert text.tokens("  a\t b ") == ["a", "b"]
    assert text.token_trigrams("日") == ["E697A5"]
    assert text.token_trigrams("é") == []


def test_descending_merges(spark):
    rows = [("A", i, None, f"a{i}", s, 0, False) for i, s in enumerate([9, 5, 1])] + [("B", i, None, f"b{i}", s, 0, False) for i, s in enumerate([8, 7])]
    r = catalog(spark, rows)
    by = lambda **k: [x.size for x in search.page(r, "size", "desc", **k).orderBy("pos").collect()]
    assert by() == [9, 8, 7, 5, 1]
    assert by(compat=True) == [8, 7, 9, 5, 1]
    assert by(limit=0) == []
    assert [x for o in range(0, 5, 2) for x in by(offset=o, limit=2)] == by()


def test_paths(spark):
    r = catalog(spark, [("d", 0, 0, "", 0, 0, True), ("d", 1, 0, "a", 0, 0, True), ("d", 2, 1, "..", 0, 0, True), ("d", 3, 2, "b", 0, 0, True), ("d", 7, 8, "x", 0, 0, True), ("d", 8, 7, "y", 0, 0, True), ("d", 9, 99, "lost", 0, 0, True)])
    got = {x.dir_id: x.path for x in paths.directory_paths(r).collect()}
    assert got == {0: "/", 1: "/a", 2: "/a", 3: "/a/b", 7: "…", 8: "…", 9: "/lost"}


def test_index_equals_scan(spark):
    r = registry.parts(spark, SF)
    posted = search.postings(r)
    for q in ("e", "red", "ed re", "zzzz", ""):
        a = {(x.device_id, x.record_idx) for x in search.indexed_search(posted, r, q, 1000).collect()}
        assert a == {(x.device_id, x.record_idx) for x in search.matching(r, q, 1000).collect()}
