"""Queries over whole tables against their SQL, and that they are not of a subset."""

import duckdb
import pytest

from graphloom import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "rows"), [
    ("bgp_chain_fk", "SELECT count(*) FROM orders"),
    ("path_plus", "SELECT 3 * (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)"),
])
def test_whole_tables(spark, name, rows):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(got) == con.execute(rows).fetchone()[0]
