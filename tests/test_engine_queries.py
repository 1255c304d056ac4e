"""Every registered query of the engine against its SQL on the small tables."""

import pytest

from sparkloom.queries import oracle_sql, queries


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = queries()[name](spark, sf_dir)
    want = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: repr([row[c] for c in sorted(columns)])
    want_rows = sorted(key(dict(zip(columns, r))) for r in want.fetchall())
    assert sorted(key(r.asDict()) for r in got.collect()) == want_rows
