import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "documents benchmark conversations lineitem".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    ours = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.toLocalIterator())))
    rel = duck.sql(entry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    assert ours == sorted(map(repr, (tuple(r[i] for i in order) for r in rel.fetchall())))


@pytest.mark.parametrize("name", [q for q in OWN if q in entry.oracle_sql() and q not in ("lsm_untrained", "lsm_segment_max3", "lsm_word_freq", "pos_save_load")])
def test_query_equals_sql(spark, duck, sf, name):
    same(spark, duck, sf, name)


def test_all_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"doc_id", "ln", "pos", "word"}
