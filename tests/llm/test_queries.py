import os

import pytest
from compare import connection, differences

from tidemark.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns)) and isinstance(rows, list)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], connection(SMALL)) == ""


def test_unmatched_are_the_misses_of_all_fields(spark):
    sf = "/root/testdata/sf0.01"
    misses: dict[str, int] = {}
    for r in queries.p5_found(spark, sf).where("canonical_id = 0").groupBy("field").count().collect():
        misses[r["field"]] = r["count"]
    got = queries.p5_unmatched(spark, sf).collect()
    assert len({(r["field"], r["value"]) for r in got}) == len(got)
    assert {f: sum(r["rows"] for r in got if r["field"] == f) for f in {r["field"] for r in got}} == misses
    assert "vessel_equipment.model" in misses
