import duckdb
import pytest

from graphloom import rulebook
from graphloom.reason.rules import CLOSED, mapping_rules, owl_rules

SF = "/root/testdata/sf0.001"


def test_every_rule_has_a_query():
    from graphloom import queries

    named = {r.name for r in owl_rules() + mapping_rules()} | set(CLOSED)
    assert named <= set(rulebook.CASES) | set(queries.RULES)


@pytest.mark.parametrize("name", ["cax-sco", "scm-eqc-rev", "cls-avf", "prp-npa1", "prp-spo2", "eq-diff2", "cls-maxqc3"])
def test_rules_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(rulebook.CASES[name].sql)
    columns = [d[0] for d in cur.description]
    got = rulebook.follow(name, spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
