"""The engine's own queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from attesta.plans import claim_queries  # noqa: F401
from attesta.plans.registry import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(str(r) for r in found.fetchall())
