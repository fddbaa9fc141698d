"""Every query with SQL gives what the SQL gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from spanloom.plans import catalog, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


def canonical(rows):
    def one(v):
        if v is None:
            return "~"
        if isinstance(v, float) or hasattr(v, "as_tuple"):
            return f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    answer = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    want = [[row[names.index(c)] for c in columns] for row in answer.fetchall()]
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship():
    assert catalog.FLAGSHIP in registry.QUERIES
