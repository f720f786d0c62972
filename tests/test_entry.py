import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"rec_id", "seg", "duration_ms", "event_count", "boundary_screenshot"}


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
