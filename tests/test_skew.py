"""One key holds most rows: slices must not change any result."""

import pytest
from pyspark.sql import functions as F

from loomshift.operators import agentlog, testlog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def log(spark):
    second = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7 + F.when(F.col("id") % 11 == 0, 900).otherwise(0))
    return spark.range(600).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 5 + 2).alias("session_id"),
        F.col("id").alias("event_id"),
        second.cast("timestamp_ntz").alias("ts"),
        F.element_at(F.array(*[F.lit(k) for k in ("permission_request", "tool_call", "permission_resolved", "error")]),
                     (F.col("id") * 7 % 4 + 1).cast("int")).alias("kind"),
        F.when(F.col("id") % 2 == 0, "once").otherwise("deny").alias("decision"),
    )


def test_permissions(log):
    assert rows(agentlog.permission_outcomes(log, max_rows=20)) == rows(agentlog.permission_outcomes(log))


def test_idle_sessions(log):
    assert rows(agentlog.idle_sessions(log, max_rows=20)) == rows(agentlog.idle_sessions(log))


def test_threads(spark):
    talk = spark.range(300).select(
        F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7 + 1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") * 5 % 3 == 0, "assistant").otherwise("user").alias("role"),
    )
    assert rows(agentlog.thread_starts(talk, max_rows=10)) == rows(agentlog.thread_starts(talk))


@pytest.fixture(scope="module")
def test_log(spark):
    kind = F.col("id") % 37
    line = (
        F.when(kind == 0, F.concat(F.lit("___ ERROR collecting tests/t_"), (F.col("id") % 10).cast("string"), F.lit(".py ___")))
        .when(kind == 30, "=== short test summary info ===")
        .when(kind == 31, F.concat(F.lit("ERROR tests/t_"), (F.col("id") % 12).cast("string"), F.lit(".py")))
        .when(kind == 32, F.concat(F.lit("FAILED tests/u_"), F.col("id").cast("string"), F.lit(".py::T::t - AssertionError: x")))
        .when(kind == 33, F.concat(F.col("id").cast("string"), F.lit(" failed, 4 passed, 1 error in 0.12s")))
        .when((kind > 5) & (F.col("id") % 4 == 0), F.concat(F.lit("E   broken "), F.repeat(F.lit("x"), 120)))
        .when(kind == 2, "  ")
        .otherwise(F.concat(F.lit("line "), F.col("id").cast("string")))
    )
    return spark.range(900).select(
        F.when(F.col("id") < 700, "big").otherwise("small").alias("run_id"), F.col("id").alias("line_no"), line.alias("line")
    )


def test_log_blocks(test_log):
    got = rows(testlog.blocks(test_log, max_rows=25))
    assert got == rows(testlog.blocks(test_log))
    assert max(len(r[3]) for r in got) == 500


def test_log_failures(test_log):
    assert rows(testlog.failures(test_log, max_rows=25)) == rows(testlog.failures(test_log))


def test_log_report_is_independent_of_partitions(test_log):
    spread = test_log.repartition(13, F.rand(3))
    assert rows(testlog.report(spread, max_rows=40)) == rows(testlog.report(test_log))


@pytest.mark.parametrize("max_rows", [1, 3, 1000])
def test_log_stretches_of_any_length(test_log, max_rows):
    assert rows(testlog.report(test_log, max_rows=max_rows)) == rows(testlog.report(test_log))
    assert rows(testlog.blocks(test_log, max_rows=max_rows)) == rows(testlog.blocks(test_log))


def test_a_report_reads_the_log_once(spark, test_log, tmp_path, monkeypatch):
    """Whatever is stored on the way, only one plan holds a scan of the log."""
    test_log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plans = []
    real = testlog.stored
    monkeypatch.setattr(testlog, "stored", lambda df, label: (plans.append(df), real(df, label))[1])
    plans.append(testlog.report(log))
    scans = [str(df._jdf.queryExecution().executedPlan().toString()).count(f"{tmp_path}/log") for df in plans]
    assert sorted(scans) == [0] * (len(scans) - 1) + [1], scans
