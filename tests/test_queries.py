import pytest
from oracle import difference

from rulegrain.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(spark, name, queries()[name], oracle_sql()[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_tool_stats_of_more_than_100_000_events(spark, tmp_path):
    events = spark.range(100_003).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts", "if(id < 2, 'first', 'later') as event_type", "double(id % 50) as value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["tool"]: (r["calls"], r["errors"]) for r in queries()["tool_stats"](spark, str(tmp_path)).collect()}
    assert got == {"first": (2, 2), "later": (100_001, sum(i % 50 < 20 for i in range(2, 100_003)))}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
