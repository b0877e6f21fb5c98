"""Streams fed one file per micro-batch against their batch twins."""

import pytest
from pyspark.sql import functions as F

from loomshift.operators import agentlog
from loomshift.plans import catalogue, inputs
from loomshift.plans.inputs import LOG
from loomshift.session import read_table, scratch
from loomshift.sources.readers import event_stream, pushed_events
from loomshift.streaming import events as stream

SF_DIR = "/root/testdata/sf0.001"
BATCHES = 4


@pytest.fixture(scope="module")
def parts(spark):
    """The events in four files, in order of time."""
    folder = scratch(spark, "parts")
    events = read_table(spark, SF_DIR, "events")
    for i in range(BATCHES):
        events.where(F.col("event_id").between(i * 250, i * 250 + 249)).coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.fixture
def log(spark, parts):
    raw = event_stream(spark, parts, read_table(spark, SF_DIR, "events").schema, files_per_batch=1)
    return spark.sql(LOG.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=raw)


@pytest.fixture(scope="module")
def batch(spark):
    return inputs.log(spark, SF_DIR).withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts(spark, log, batch):
    got = stream.run_upsert(stream.counts(log), scratch(spark, "c"), ["window_start", "kind"])
    assert rows(got) == rows(agentlog.event_counts(batch))


def test_usage(spark, log, batch):
    folder = scratch(spark, "u")
    got = stream.run_upsert(stream.usage(log), folder, ["session_id"])
    assert rows(got) == rows(agentlog.usage_cost(batch).drop("cost"))
    # four batches were written, and a second run over the same files adds none
    again = stream.run_upsert(stream.usage(log), folder, ["session_id"])
    assert rows(again) == rows(got)
    assert spark.read.parquet(f"{folder}/out").select("batch").distinct().count() == BATCHES


def test_idle_sessions(spark, log, batch):
    gap = 6 * 3600
    got = stream.run_append(stream.idle_sessions(log, gap, "0 seconds"), scratch(spark, "i"))
    micros = [F.unix_micros("started"), F.unix_micros("closed"), F.col("events")]
    watermark = batch.agg(F.max("ts")).first()[0]
    want = agentlog.idle_sessions(batch, gap).select("session_id", "started", (F.col("ended") + gap * 1_000_000).alias("closed"), "events")
    want = want.where(F.col("closed") <= F.floor(F.unix_micros(F.lit(watermark)) / 1000) * 1000)
    assert rows(got.select("session_id", *micros)) == rows(want)


def test_permissions_time_out(spark, log):
    by_id = log.withColumn("id", F.col("k"))
    got = stream.first_answers(stream.run_append(stream.permission_outcomes(by_id, 86400), scratch(spark, "p"))).collect()
    assert {r.decision for r in got} <= {"once", "always", "deny"}
    assert len({r.request_id for r in got}) == len(got)


def test_steps(spark, log, batch):
    cancelled = log.withColumn("cancelled", F.col("kind") == "error")
    got = stream.run_upsert(stream.step_cap(cancelled, 3), scratch(spark, "s"), ["session_id"])
    want = batch.groupBy("session_id").agg(F.count_if(F.col("kind") == "tool_call").alias("n"), F.bool_or(F.col("kind") == "error").alias("c"))
    assert rows(got) == rows(want.select("session_id", F.least("n", F.lit(3)), F.col("n") > 3, "c"))


def test_pushed_lines(spark, tmp_path):
    lines = [
        'data: {"kind": "connected", "session": "s"}', "", ": keepalive", 'data: {"kind": "tool_result", "id": "1", "ok": false}',
        "data: {broken",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("\n".join(lines))
    job = pushed_events(spark.readStream.text(str(tmp_path / "in"))).select("kind", "ok", "broken")
    got = stream.run_append(job, scratch(spark, "push"))
    assert rows(got) == [("connected", None, None), ("tool_result", False, None), (None, None, "{broken")]


def test_two_answers_to_one_request(spark):
    rows = [(0, "permission_request", None), (5, "permission_resolved", "once"), (3, "permission_resolved", "always"), (9, "permission_request", None)]
    log = spark.createDataFrame([("s", 1, n, kind, d) for n, kind, d in rows], "session_id string, id long, event_id long, kind string, decision string")
    log = log.withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000))
    folder = scratch(spark, "two")
    log.write.parquet(folder)
    job = stream.permission_outcomes(event_stream(spark, folder, log.schema), 60)
    got = stream.first_answers(stream.run_append(job, scratch(spark, "out"))).collect()
    assert [(r.request_id, r.decision) for r in got if r.request_id == 0] == [(0, "always")]


QUERIES = ["stream_event_counts", "stream_idle_sessions", "stream_idle_sessions_6h", "stream_permission_timeout", "stream_usage", "stream_step_cap"]


@pytest.mark.parametrize("name", QUERIES)
def test_tables_of_many_files(spark, tmp_path, name):
    """A table that is a folder of part files gives what the single file gives."""
    query = catalogue.QUERIES[name]
    read_table(spark, SF_DIR, "events").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    want = rows(query(spark, SF_DIR))
    assert want and rows(query(spark, str(tmp_path))) == want


def test_empty_stream(spark, tmp_path):
    schema = read_table(spark, SF_DIR, "events").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "events.parquet"))
    for name in QUERIES:
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 0
