import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "best_metric" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_match_at_small_scale(spark):
    """All oracle-backed queries against DuckDB at sf0.001."""
    import duckdb
    from checks.compare import _digest
    from parley.fixtures import TABLES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = []
    for name, sql in entry.oracle_sql().items():
        df = entry.queries()[name](spark, sf)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(sql)
        ocols = [d[0] for d in res.description]
        orows = [tuple(r[ocols.index(c)] for c in cols) for r in res.fetchall()]
        if sorted(cols) != sorted(ocols) or _digest(cols, rows)[0] != _digest(cols, orows)[0]:
            bad.append(name)
    assert bad == []
