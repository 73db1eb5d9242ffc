"""Every registered query of the engine against its SQL on the small tables."""

import duckdb
import pytest

from spillway.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, order):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db):
    df = QUERIES[name](spark, SF)
    have = df.collect()
    if name not in ORACLE_SQL:
        return
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = cursor.fetchall()
    assert plain(have, [df.columns.index(c) for c in sorted(names)]) == plain(want, [names.index(c) for c in sorted(names)])


def test_filters_reach_the_scan(spark):
    plan = QUERIES["flagship"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in plan
    assert "l_comment" not in plan and "row_index" not in plan
