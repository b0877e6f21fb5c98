"""Queries over the event log: permissions, calls, usage, steps, threads, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshift import fixed
from loomshift.operators import agentlog
from loomshift.plans import inputs
from loomshift.plans.inputs import with_ctes
from loomshift.plans.registry import query
from loomshift.sources import readers

_LOG = with_ctes(log=inputs.LOG)
_TALK = with_ctes(talk=inputs.MESSAGES)

DEFAULTS = {"read_file": "allow", "list_files": "allow", "edit_file": "ask", "write_file": "ask", "run_bash": "ask"}
OVERRIDES = {"list_files": "deny"}


@query(
    "policy_audit",
    _LOG.rstrip() + """,
    ruled AS (SELECT session_id, event_id, tool, decision, CASE tool WHEN 'read_file' THEN 'allow' WHEN 'list_files' THEN 'deny' ELSE 'ask' END AS policy FROM log),
    seen AS (SELECT *, coalesce(bool_or(decision = 'always' AND policy = 'ask') OVER (PARTITION BY session_id, tool ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS covered FROM ruled),
    decided AS (SELECT *, CASE policy WHEN 'deny' THEN FALSE WHEN 'allow' THEN TRUE ELSE covered OR decision = 'once' END AS allowed FROM seen)
    SELECT session_id, event_id, tool, policy, allowed, CASE WHEN policy = 'deny' THEN 'Tool ''' || tool || ''' is denied by configuration.' WHEN allowed THEN '' ELSE 'User denied this tool call.' END AS reason FROM decided
    """,
)
def policy_audit(spark, sf_dir):
    """Which calls were allowed, with session memory of `always`."""
    calls = inputs.log(spark, sf_dir).select("session_id", F.col("event_id").alias("call_no"), "tool", "decision")
    audited = agentlog.policy_audit(calls, DEFAULTS, OVERRIDES)
    return audited.select("session_id", F.col("call_no").alias("event_id"), "tool", "policy", "allowed", "reason")


@query(
    "tool_pairing",
    _TALK + """
    SELECT q.conv_id AS session_id, q.turn AS id, CASE WHEN a.conv_id IS NULL THEN 'running' WHEN length(a.text) % 2 = 0 THEN 'ok' ELSE 'error' END AS status,
      CASE WHEN a.conv_id IS NOT NULL THEN coalesce(nullif(a.text, ''), '(no output)') END AS preview
    FROM talk q LEFT JOIN talk a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'
    """,
)
def tool_pairing(spark, sf_dir):
    """A user turn is the call, the assistant turn after it the result."""
    talk = inputs.derived(spark, sf_dir, inputs.MESSAGES)
    calls = talk.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"))
    results = talk.where("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("id"), F.col("turn").alias("ts_no"),
        (F.length("text") % 2 == 0).alias("ok"), F.col("text").alias("preview"),
    )
    return agentlog.pair_calls(calls, results)


_PERMISSION = _LOG.rstrip() + """,
asked AS (SELECT * FROM log WHERE kind = 'permission_request'), said AS (SELECT * FROM log WHERE kind = 'permission_resolved'),
nearest AS (SELECT q.session_id, q.event_id, q.ts, r.ts AS moment, r.decision FROM asked q ASOF LEFT JOIN said r ON q.session_id = r.session_id AND r.ts >= q.ts)
SELECT session_id, event_id, epoch_us(ts) AS asked_micros, CASE WHEN epoch_us(moment) - epoch_us(ts) <= {s}::BIGINT * 1000000 THEN decision ELSE 'deny' END AS decision,
  CASE WHEN epoch_us(moment) - epoch_us(ts) <= {s}::BIGINT * 1000000 THEN epoch_us(moment) - epoch_us(ts) END AS waited_micros FROM nearest
"""


def _permissions(spark, sf_dir, seconds):
    out = agentlog.permission_outcomes(inputs.log(spark, sf_dir), seconds)
    return out.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).withColumnRenamed("ts", "asked_micros")


@query("permission_timeout", _PERMISSION.replace("{s}", "600"))
def permission_timeout(spark, sf_dir):
    """The next answer within 600 s, else deny."""
    return _permissions(spark, sf_dir, fixed.PERMISSION_TIMEOUT_S)


@query("permission_timeout_6h", _PERMISSION.replace("{s}", "21600"))
def permission_timeout_6h(spark, sf_dir):
    """J9 with six hours, so that answers do arrive in time."""
    return _permissions(spark, sf_dir, 6 * 3600)


@query(
    "permission_by_id",
    _LOG.rstrip() + """,
    asked AS (SELECT * FROM log WHERE kind = 'permission_request'), said AS (SELECT * FROM log WHERE kind = 'permission_resolved'),
    nearest AS (SELECT q.session_id, q.k, q.event_id, q.ts, r.ts AS moment, r.decision FROM asked q ASOF LEFT JOIN said r ON q.session_id = r.session_id AND q.k = r.k AND r.ts >= q.ts)
    SELECT session_id, event_id, epoch_us(ts) AS asked_micros, CASE WHEN epoch_us(moment) - epoch_us(ts) <= 86400::BIGINT * 1000000 THEN decision ELSE 'deny' END AS decision,
      CASE WHEN epoch_us(moment) - epoch_us(ts) <= 86400::BIGINT * 1000000 THEN epoch_us(moment) - epoch_us(ts) END AS waited_micros FROM nearest
    """,
)
def permission_by_id(spark, sf_dir):
    """J9 with request ids: the next answer to the same id within a day."""
    out = agentlog.permission_outcomes(inputs.log(spark, sf_dir), 86400, keys=["session_id", "k"])
    return out.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).withColumnRenamed("ts", "asked_micros")


@query(
    "usage_cost",
    _LOG + """
    SELECT session_id, i AS input_tokens, o AS output_tokens, r AS cache_read, w AS cache_write, round(CAST(i * 3.00 + o * 15.00 + r * 0.30 + w * 3.75 AS DOUBLE) / 1000000, 8) AS cost
    FROM (SELECT session_id, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(cache_read) AS BIGINT) AS r, CAST(sum(cache_write) AS BIGINT) AS w FROM log GROUP BY session_id)
    """,
)
def usage_cost(spark, sf_dir):
    """Summed in decimals."""
    return agentlog.usage_cost(inputs.log(spark, sf_dir)).withColumn("cost", F.col("cost").cast("double"))


@query(
    "step_cap",
    _LOG + """
    SELECT session_id, event_id, step, n > 60 AS capped FROM (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS step, count(*) OVER (PARTITION BY session_id) AS n FROM log) WHERE step <= 60
    """,
)
def step_cap(spark, sf_dir):
    """W9."""
    steps = inputs.log(spark, sf_dir).select("session_id", "event_id", F.col("ts").alias("step_ts"))
    return agentlog.capped_steps(steps).select("session_id", "event_id", "step", "capped")


@query(
    "thread_reset",
    _TALK + """
    SELECT conv_id, arg_max(role, turn) AS last_role, arg_max(role, turn) = 'user' AS fresh, count(*) FILTER (role = 'user' AND before = 'user') AS breaks
    FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM talk) GROUP BY conv_id
    """,
)
def thread_reset(spark, sf_dir):
    """W10."""
    return agentlog.thread_starts(inputs.derived(spark, sf_dir, inputs.MESSAGES).select("conv_id", "turn", "role"))


def _idle_sql(seconds: int) -> str:
    return _LOG.rstrip() + f""",
    spaced AS (SELECT session_id, event_id, epoch_us(ts) AS moment, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prior FROM log),
    numbered AS (SELECT *, CAST(sum(CASE WHEN prior IS NULL OR moment - prior >= {seconds}::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY moment, event_id) AS BIGINT) AS stretch FROM spaced)
    SELECT session_id, stretch, min(moment) AS started, max(moment) AS ended, count(*) AS events FROM numbered GROUP BY ALL
    """


@query("idle_sessions", _idle_sql(12))
def idle_sessions(spark, sf_dir):
    """ST2 in batch: stretches split by 12 s of silence."""
    return agentlog.idle_sessions(inputs.log(spark, sf_dir))


@query("idle_sessions_6h", _idle_sql(21600))
def idle_sessions_6h(spark, sf_dir):
    """ST2 in batch with six hours."""
    return agentlog.idle_sessions(inputs.log(spark, sf_dir), 6 * 3600)


PUSHED = """
SELECT event_id, concat(CASE WHEN k % 10 = 0 THEN ': keepalive' WHEN k % 10 = 1 THEN 'data: {"kind": "cut' ELSE concat(
    'data: {"kind": "', kind, '", "id": "', CAST(event_id AS STRING), '", "tool": "', tool, '", "ok": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END,
    ', "decision": "', decision, '"}') END) AS value FROM (""" + inputs.LOG + ") l"


@query(
    "event_parse",
    with_ctes(log=inputs.LOG) + """
    SELECT event_id, CASE WHEN k % 10 <> 1 THEN kind END AS kind, CASE WHEN k % 10 <> 1 THEN CAST(event_id AS VARCHAR) END AS id, CASE WHEN k % 10 <> 1 THEN tool END AS tool,
      CASE WHEN k % 10 <> 1 THEN CAST(k % 2 = 0 AS VARCHAR) END AS ok, CASE WHEN k % 10 <> 1 THEN decision END AS decision, CASE WHEN k % 10 = 1 THEN '{"kind": "cut' END AS broken
    FROM log WHERE k % 10 <> 0
    """,
)
def event_parse(spark, sf_dir):
    """Events out of the lines of a server push."""
    events = readers.pushed_events(inputs.derived(spark, sf_dir, PUSHED))
    return events.select("event_id", "kind", "id", "tool", F.col("ok").cast("string").alias("ok"), "decision", "broken")


@query(
    "event_counts",
    _LOG + "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS hour_start, kind, count(*) AS n FROM log GROUP BY ALL",
)
def event_counts(spark, sf_dir):
    """ST1 in batch."""
    counted = agentlog.event_counts(inputs.log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return counted.select(F.unix_seconds("window_start").alias("hour_start"), "kind", "n")
