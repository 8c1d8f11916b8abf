"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from kinetrack.plans import queries as q

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], *[tuple(repr(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else repr(r[i]) for i in order)]) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_rows(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    want = duck.execute(q.ORACLES[name])
    names = [d[0] for d in want.description]
    got = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in df.collect()]
    exp = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, exp)


def test_entry(spark):
    assert q.entry(spark, SF).count() > 0
