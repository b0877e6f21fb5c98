"""Every registered query: its rows against its SQL, and its plan."""

import re

import pytest

import __spark_entry__ as entry
from loomshift.plans import catalogue
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalogue.QUERIES
ORACLES = catalogue.ORACLES

# work within a row: no shuffle at all
NARROW = [
    "classify_files", "output_paths", "review_flags", "line_window", "text_truncate", "strip_settings", "strip_fences",
    "header_stamp", "ddl_detect", "path_map_inline", "qualify_refs", "rewrite_paths", "rename_dbs", "ddl_targets",
    "residual_vars", "filter_extract", "filter_notes", "sql_params", "dag_extract", "function_usage", "config_rename",
    "py_syntax_check", "fn_epoch", "fn_dates", "fn_arrays", "fn_json", "fn_casts", "insert_coercion", "type_map",
    "type_map_arrays", "type_names", "path_map_many", "injected_filters", "ingest_filter", "param_predicate", "union_by_name",
]
# columns read and filters pushed down
SCANS = {
    "win_row_number": ("o_orderkey:bigint,o_custkey:bigint,o_totalprice:double", ""),
    "group_count": ("l_returnflag:string,l_linestatus:string", ""),
    "injected_filters": ("o_orderkey:bigint,o_totalprice:double,o_orderstatus:string,o_orderdate:timestamp_ntz", "GreaterThanOrEqual(o_orderdate"),
    "param_predicate": ("o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz", "LessThan(o_orderdate"),
    "idle_sessions": ("event_id:bigint,ts:timestamp_ntz,user_id:bigint", ""),
}


@pytest.fixture(scope="module")
def con():
    with connect(SF_DIR) as c:
        yield c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    problem, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR, df)
    assert problem is None, problem
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|FlatMapGroupsInPandas", plan)
    if name in NARROW:
        assert not re.search("Exchange (hash|range|Round|Single)", plan)


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    columns, pushed = SCANS[name]
    read = [set(m.split(",")) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    assert set(columns.split(",")) in read
    assert pushed in plan


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "file_type", "files", "chars", "files_converted", "dry_run_passed", "dry_run_failed", "needs_review", "errors", "skipped"]
