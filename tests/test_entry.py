import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CHECKED = ("profile_lexical", "curate_budget", "spc_events", "ledger_versions", "report_by_source", "cohort_outliers", "html_gate_pages", "json_balanced", "candidate_grid_objective", "spc_throughput", "baseline_dict_oov")


def test_every_oracle_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "events", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    show = lambda df: sorted(tuple(f"{v:.5g}" if isinstance(v, float) else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert show(got) == show(want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
