"""Registered queries against their DuckDB oracles on the smallest tables
(row count, column names, order-free value hash), plus plan checks."""

import os
import sys

import pytest

from tests.conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SAMPLE = ["active_by_state", "clean_companies", "clean_establishments", "search_view_active", "person_detail",
          "funding_by_state", "gini_by_state", "funding_overview", "clean_patents", "patents_by_ipc",
          "company_network_d2", "person_network_d1", "assign_polygon", "fn_validation_status",
          "incomplete_months", "detect_changes", "topic_keywords", "build_crosswalk", "gq_link_chain"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    from compare import digest
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["uf", "companies", "capital"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_or_cartesian(spark):
    import __spark_entry__ as E
    for key in ["search_view_active", "funding_overview", "company_network_d1", "assign_polygon", "topic_keywords"]:
        p = _plan(E.queries()[key](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key


def test_filter_pushed_to_scan(spark):
    from tessera.sources.proxies import table
    df = table(spark, SF_SMALL, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in p
