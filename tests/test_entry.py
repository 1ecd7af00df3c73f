import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"OBJECT_ID", "is_zero", "PREVIOUS_PREMIUM", "TOTAL_DURATION"}
    assert df.count() > 0


def test_registry_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    # The llm queries come and go with their subpackage; the library's own are always there.
    assert {"a1_policies", "k1_base_clean_train", "m8_backtest"} <= set(q)


def test_oracle_matches_on_a_few_queries(spark):
    con = duckdb.connect()
    for t in ["lineitem", "part"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["k1_base_clean_train", "e13_object_state", "j2_frequent_itemsets", "k4_cap_metrics"]:
        sp = entry.queries()[name](spark, SF).toPandas()
        dk = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(sp.columns) == sorted(dk.columns), name
        cols = sorted(sp.columns)
        norm = lambda df: sorted(repr(tuple(None if v != v else (round(float(v), 6) if isinstance(v, float) else v)
                                            for v in r)) for r in df[cols].itertuples(index=False))
        assert norm(sp) == norm(dk), name
