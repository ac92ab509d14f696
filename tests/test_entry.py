"""Driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"wine_id", "region", "year", "station", "dist_km", "hot_days"} <= set(df.columns)


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 70 and len(s) >= 55
    assert all(isinstance(v, str) and v.strip() for v in s.values())
