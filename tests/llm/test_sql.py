"""Queries against their SQL on the small tables."""

from pathlib import Path

import pytest

from veridoc.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    c = con.execute(queries.SQL[name])
    names = [x[0] for x in c.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    want = sorted((tuple(r) for r in c.fetchall()), key=str)
    assert want and sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want
