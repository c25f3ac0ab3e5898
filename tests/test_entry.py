import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from veridoc.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = registry.QUERIES[name](spark, SMALL)
    c = con.execute(registry.SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda v: round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v
    want = sorted((tuple(plain(r[names.index(k)]) for k in sorted(names)) for r in c.fetchall()), key=str)
    assert sorted((tuple(plain(r[k]) for k in sorted(names)) for r in got.collect()), key=str) == want


def test_without_training_data_operators(tmp_path):
    """All else works if that subpackage is gone."""
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "veridoc", tmp_path / "veridoc", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"})


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the test tables")
def test_pages_are_computed_once(spark):
    """No filter is inferred that would compute the zone's rows in the scan as well."""
    from veridoc.sources import derived

    pages = derived.passport_pages(spark, SMALL)
    assert "Filter " not in pages._jdf.queryExecution().executedPlan().toString()
    assert pages.count() == 10 * spark.read.parquet(f"{SMALL}/customer.parquet").count()
