"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from foliomill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "events", "pages", "labels", "benchmark", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
    answer = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in answer.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted(tuple(plain(row[i]) for i in order) for row in answer.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    # what is found depends on the texts; these may have nothing to find
    assert registry.QUERIES[name](spark, DATA).count() > 0 or name in ("amounts_in_documents",)


@pytest.mark.parametrize("name", ["room", "letters_in_art", "spans_over_art", "hidden_places", "art_near_text"])
def test_no_nested_loops(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
