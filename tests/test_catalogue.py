"""Every catalogue query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from codeloom.plans import catalogue

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.O))
def test_query(spark, duck, name):
    got, want = catalogue.Q[name](spark, AT).toPandas(), duck.execute(catalogue.O[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).astype(str).values.tolist()))
    assert rows(got) == rows(want)
