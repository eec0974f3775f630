"""The registered queries of the operators on the smallest tables, against their SQL where they have it."""

import pytest

from vecloom.llm import queries as q
from vecloom.session import ship_package

from ..test_catalog import con, same  # noqa: F401


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sf, con, name):  # noqa: F811
    ship_package(spark)
    df = q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got
    if name in q.oracle_sql():
        want = con.sql(q.oracle_sql()[name])
        assert sorted(want.columns) == columns
        rows = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)
        assert len(got) == len(rows) and all(same(x, y) for a, b in zip(got, rows) for x, y in zip(a, b))
