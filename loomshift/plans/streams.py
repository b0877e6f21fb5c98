"""Structured Streaming queries over the event files, run over what is there now."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomshift.operators.ordered import OrderedGroups
from loomshift.plans import inputs
from loomshift.plans.inputs import with_ctes
from loomshift.plans.registry import query
from loomshift.session import read_table, scratch
from loomshift.sources.readers import event_stream, pushed_chunks, pushed_events
from loomshift.streaming import events as stream
from loomshift.streaming import stateful

_LOG = with_ctes(log=inputs.LOG)


def log_stream(spark, sf_dir):
    """The event files as a stream of log rows."""
    schema = read_table(spark, sf_dir, "events").schema
    raw = event_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema)
    select = re.sub(r"\bFROM events\b", "FROM {events}", inputs.LOG.replace("{", "{{").replace("}", "}}"))
    return spark.sql(select, events=raw)


@query(
    "stream_event_counts",
    _LOG + "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS hour_start, kind, count(*) AS n FROM log GROUP BY ALL",
)
def stream_event_counts(spark, sf_dir):
    """S13, ST1: the last update of each window and kind."""
    job = stream.counts(log_stream(spark, sf_dir))
    done = stream.run_upsert(job, scratch(spark, "counts"), ["window_start", "kind"])
    return done.select(F.unix_seconds("window_start").alias("hour_start"), "kind", "n")


def _idle_sql(seconds: int) -> str:
    # append mode keeps back sessions that end after the watermark
    return _LOG.rstrip() + f""",
    spaced AS (SELECT session_id, event_id, epoch_us(ts) AS moment, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prior FROM log),
    numbered AS (SELECT *, sum(CASE WHEN prior IS NULL OR moment - prior >= {seconds}::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY moment, event_id) AS stretch FROM spaced)
    SELECT session_id, min(moment) AS started, max(moment) + {seconds}::BIGINT * 1000000 AS closed, count(*) AS events FROM numbered GROUP BY session_id, stretch
    HAVING max(moment) + {seconds}::BIGINT * 1000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM log)
    """


def _idle(spark, sf_dir, seconds):
    job = stream.idle_sessions(log_stream(spark, sf_dir), seconds, "0 seconds")
    done = stream.run_append(job, scratch(spark, "idle"))
    return done.select("session_id", F.unix_micros("started").alias("started"), F.unix_micros("closed").alias("closed"), "events")


@query("stream_idle_sessions", _idle_sql(12))
def stream_idle_sessions(spark, sf_dir):
    """ST2: sessions closed by 12 s of silence, as far as the watermark has passed them."""
    return _idle(spark, sf_dir, 12)


@query("stream_idle_sessions_6h", _idle_sql(21600))
def stream_idle_sessions_6h(spark, sf_dir):
    """ST2 with six hours."""
    return _idle(spark, sf_dir, 21600)


@query(
    "stream_permission_timeout",
    _LOG + """
    SELECT session_id, id, request_id, asked_at, arg_min(decision, (said_at, decision)) AS decision FROM (
    SELECT q.session_id, q.k AS id, q.event_id AS request_id, epoch_us(q.ts) AS asked_at, coalesce(epoch_us(r.ts), 0) AS said_at, coalesce(r.decision, 'deny') AS decision
    FROM (SELECT * FROM log WHERE kind = 'permission_request') q
    LEFT JOIN (SELECT * FROM log WHERE kind = 'permission_resolved') r ON q.session_id = r.session_id AND q.k = r.k AND r.ts BETWEEN q.ts AND q.ts + INTERVAL 24 HOURS
    WHERE r.k IS NOT NULL OR epoch_us(q.ts) + 86400000000 < (SELECT least(max(epoch_us(ts)) FILTER (kind = 'permission_request'), max(epoch_us(ts)) FILTER (kind = 'permission_resolved')) // 1000 * 1000 - 600000000 FROM log))
    GROUP BY ALL
    """,
)
def stream_permission_timeout(spark, sf_dir):
    """ST3: answers to the same id within a day, else deny once the watermark has passed."""
    log = log_stream(spark, sf_dir).withColumn("id", F.col("k"))
    done = stream.run_append(stream.permission_outcomes(log, 86400), scratch(spark, "permission"))
    return stream.first_answers(done).withColumn("asked_at", F.unix_micros("asked_at"))


@query(
    "stream_usage",
    _LOG + """
    SELECT session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
      CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write FROM log GROUP BY session_id
    """,
)
def stream_usage(spark, sf_dir):
    """ST4."""
    return stream.run_upsert(stream.usage(log_stream(spark, sf_dir)), scratch(spark, "usage"), ["session_id"])


@query(
    "stream_step_cap",
    _LOG + """
    SELECT session_id, least(n, 10) AS steps, n > 10 AS capped, cancelled FROM (
      SELECT session_id, count(*) FILTER (kind = 'tool_call') AS n, bool_or(kind = 'error' AND k < 10) AS cancelled FROM log GROUP BY session_id)
    """,
)
def stream_step_cap(spark, sf_dir):
    """ST5: steps per session against a cap of ten."""
    log = log_stream(spark, sf_dir).withColumn("cancelled", (F.col("kind") == "error") & (F.col("k") < 10))
    return stream.run_upsert(stream.step_cap(log, 10), scratch(spark, "steps"), ["session_id"])


# --- state that ends -----------------------------------------------------------------------------

_GAP = 21600


def _runs_sql(columns: str) -> str:
    # a run is given once the watermark, ten minutes behind the last event, has passed its silence
    return _LOG.rstrip() + f""",
    spaced AS (SELECT *, epoch_us(ts) AS moment, kind = 'error' AND k < 10 AS cancel, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prior FROM log),
    numbered AS (SELECT *, sum(CASE WHEN prior IS NULL OR moment - prior >= {_GAP}::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY moment, event_id) AS stretch FROM spaced),
    stopped AS (SELECT *, min(CASE WHEN cancel THEN (moment, event_id) END) OVER (PARTITION BY session_id, stretch) AS stop FROM numbered),
    runs AS (SELECT session_id, min(moment) AS started, max(moment) + {_GAP}::BIGINT * 1000000 AS closed, count(*) AS events,
        {", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in stateful.TOKENS)},
        count(*) FILTER (kind = 'tool_call' AND (stop IS NULL OR (moment, event_id) < stop)) AS n, bool_or(stop IS NOT NULL) AS stopped
      FROM stopped GROUP BY session_id, stretch)
    SELECT session_id, started, closed, {columns} FROM runs WHERE closed <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM log)
    """


def _runs(spark, sf_dir):
    cancel = (F.col("kind") == "error") & (F.col("k") < 10)
    return stream.run_append(stateful.session_runs(log_stream(spark, sf_dir), _GAP, 2, cancel=cancel), scratch(spark, "runs"))


@query("stream_usage_runs", _runs_sql("events, " + ", ".join(stateful.TOKENS)))
def stream_usage_runs(spark, sf_dir):
    """ST4: token sums of each run of a session, whose state ends after six silent hours."""
    return _runs(spark, sf_dir).select("session_id", "started", "closed", "events", *stateful.TOKENS)


@query("stream_step_runs", _runs_sql("least(n, 2) AS steps, n > 2 AS capped, stopped AND n <= 2 AS cancelled"))
def stream_step_runs(spark, sf_dir):
    """ST5: steps of each run against a cap of two, or up to the event that cancels it."""
    return _runs(spark, sf_dir).select("session_id", "started", "closed", "steps", "capped", "cancelled")


@query(
    "stream_permission_once",
    _LOG + """
    SELECT * FROM (
    SELECT q.session_id, q.k AS id, q.event_id AS request_id, epoch_us(q.ts) AS asked_at, min(epoch_us(r.ts)) AS said_at,
      coalesce(arg_min(r.decision, (epoch_us(r.ts), r.decision)), 'deny') AS decision
    FROM (SELECT * FROM log WHERE kind = 'permission_request') q
    LEFT JOIN (SELECT * FROM log WHERE kind = 'permission_resolved') r ON q.session_id = r.session_id AND q.k = r.k AND r.ts BETWEEN q.ts AND q.ts + INTERVAL 24 HOURS
    GROUP BY ALL)
    WHERE coalesce(said_at, asked_at + 86400000000) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM log WHERE kind LIKE 'permission%')
    """,
)
def stream_permission_once(spark, sf_dir):
    """ST3: one answer per request inside the stream, the first within a day or a refusal."""
    log = log_stream(spark, sf_dir).withColumn("id", F.col("k"))
    return stream.run_append(stateful.answers_once(log, 86400), scratch(spark, "once"))


@query(
    "stream_pushed_order",
    _LOG + """
    SELECT CAST(session_id % 16 AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY session_id % 16 ORDER BY event_id) AS seq,
      kind, CAST(event_id AS VARCHAR) AS id FROM log
    """,
)
def stream_pushed_order(spark, sf_dir):
    """Push logs that land in chunks, read as a stream and handed on in order, a number per line."""
    folder = scratch(spark, "pushed")
    log = inputs.log(spark, sf_dir).withColumn("session", (F.col("session_id") % 16).cast("string"))
    placed = OrderedGroups(log, ["session"], ["event_id"]).row_number("n").result()
    body = F.to_json(F.struct("kind", F.col("event_id").cast("string").alias("id")))
    rows = placed.select("session", F.floor((F.col("n") - 1) / 1000).alias("chunk"), "n", F.concat(F.lit("data: "), body).alias("value"))
    files = rows.repartition("session", "chunk").sortWithinPartitions("session", "chunk", "n")
    files.select("session", "chunk", "value").write.partitionBy("session", "chunk").text(folder)
    done = stream.run_append(stateful.in_order(pushed_chunks(spark, folder)), scratch(spark, "ordered"))
    return pushed_events(done, "line").select("session_id", "seq", "kind", "id")
