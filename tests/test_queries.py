"""The driver's queries against their SQL on the small tables."""

import duckdb
import pytest

from ledgerlake.plans import log_queries, table_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = table_queries.QUERIES | log_queries.QUERIES, table_queries.SQL | log_queries.SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str(tuple(round(float(x), 4) if isinstance(x, (int, float)) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(out.select(*columns).collect()) == plain(db.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
