"""Every query with SQL beside it gives the same rows as DuckDB; the others give rows."""

import math

import duckdb
import pytest

from cairnlake import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    rows = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in rows.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(columns)
    expected = sorted([tuple(plain(r[columns.index(c)]) for c in order) for r in rows.fetchall()], key=repr)
    got = sorted([tuple(plain(r[c]) for c in order) for r in found.collect()], key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_imports_without_the_llm_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['cairnlake.llm'] = None; import __spark_entry__ as e; assert 'b2_latest_wins' in e.queries() and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
