"""Every query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from sumac.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows):
    return sorted((tuple(round(x, 7) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    frame = QUERIES[name](spark, sf)
    if name not in ORACLE_SQL:
        assert frame.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    got = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert plain(got) == plain(expected)
