import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from webspark.plans import catalog

WHERE = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{WHERE}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as from read_parquet('{path}')")
    df = catalog.QUERIES[name](spark, WHERE)
    order = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    cur = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert mine == theirs
