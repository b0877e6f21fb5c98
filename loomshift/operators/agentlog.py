"""Analytics over a log of tool calls, permissions and turns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift import fixed
from loomshift.operators.ordered import GROUP_LIMIT, MAX_GROUP_ROWS, OrderedGroups, first_rows
from loomshift.session import stored


def policy_audit(calls: DataFrame, defaults: Mapping[str, str], overrides: Mapping[str, str],
                 auto_approve: bool = False) -> DataFrame:
    """calls(session_id, call_no, tool, decision): adds policy, allowed and reason.

    deny beats allow beats ask; an `always` answer covers later calls of the
    same tool in the session.
    """
    rules = {**defaults, **overrides}
    policy = F.try_element_at(F.create_map(*[F.lit(x) for p in rules.items() for x in p]), F.col("tool"))
    tagged = calls.withColumn("policy", F.coalesce(policy, F.lit("ask")))
    # the first `always` per session and tool: one small row each, however long the
    # session; stored, so the log is shuffled only when these rows are many
    always = (
        tagged.where((F.col("policy") == "ask") & (F.col("decision") == "always"))
        .groupBy("session_id", "tool").agg(F.min("call_no").alias("__since"))
    )
    joined = tagged.join(stored(always, "always"), ["session_id", "tool"], "left")
    covered = F.coalesce(F.col("__since") <= F.col("call_no"), F.lit(False)) | F.lit(auto_approve)
    allowed = (
        F.when(F.col("policy") == "deny", False)
        .when(F.col("policy") == "allow", True)
        .when(covered, True)
        .otherwise(F.coalesce(F.col("decision") == "once", F.lit(False)))
    )
    denied_rule, no_prompt = (F.concat(F.lit("Tool '"), F.col("tool"), F.lit(t)) for t in (fixed.DENIED_BY_RULE, fixed.NO_PROMPTER))
    reason = (
        F.when(F.col("policy") == "deny", denied_rule)
        .when(allowed, "")
        .when(F.col("decision").isNull(), no_prompt)
        .otherwise(fixed.DENIED_BY_USER)
    )
    return joined.withColumn("allowed", allowed).withColumn("reason", reason).drop("__since")


def pair_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls(session_id, id, ...) with the outcome of results(session_id, id, ts_no, ok, preview).

    The last result of a call counts; a call without one is still running;
    results for unknown calls are dropped.
    """
    last = results.groupBy("session_id", "id").agg(F.max_by(F.struct("ok", "preview"), "ts_no").alias("r"))
    status = F.when(F.col("r").isNull(), "running").when(F.col("r.ok"), "ok").otherwise("error")
    preview = F.when(F.col("r").isNotNull(), F.coalesce(F.nullif("r.preview", F.lit("")), F.lit("(no output)")))
    return calls.join(last, ["session_id", "id"], "left").withColumns({"status": status, "preview": preview}).drop("r")


def permission_outcomes(log: DataFrame, timeout_s: int = fixed.PERMISSION_TIMEOUT_S, max_rows: int = MAX_GROUP_ROWS,
                        keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """log(session_id, event_id, ts, kind, decision, ...): each request with its decision.

    The next answer of the same keys within the timeout counts, else `deny`. Where requests have an id, the keys are the
    session and the id; the session alone is for logs without ids.
    """
    resolved = F.col("kind") == "permission_resolved"
    answer = F.when(resolved, F.struct(F.col("ts").alias("at"), F.col("decision").alias("said")))
    asked_or_said = log.where(F.col("kind").isin("permission_request", "permission_resolved"))
    seen = OrderedGroups(asked_or_said, list(keys), ["ts", "event_id"], max_rows).next_known(answer, "next").result()
    requests = seen.where(F.col("kind") == "permission_request")
    waited = F.unix_micros(F.col("next.at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    in_time = F.coalesce(waited <= timeout_s * 1_000_000, F.lit(False))
    return requests.select(
        "session_id", "event_id", "ts",
        F.when(in_time, F.col("next.said")).otherwise("deny").alias("decision"),
        F.when(in_time, waited).alias("waited_micros"),
    )


def usage_cost(usage: DataFrame, key: str = "session_id") -> DataFrame:
    """Token sums and cost in dollars per session."""
    prices = {
        "input_tokens": fixed.PRICE_INPUT,
        "output_tokens": fixed.PRICE_OUTPUT,
        "cache_read": fixed.PRICE_CACHE_READ,
        "cache_write": fixed.PRICE_CACHE_WRITE,
    }
    sums = usage.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in prices])
    cost: Column = F.lit(0).cast("decimal(28,8)")
    for c, price in prices.items():
        per_token = F.lit(Decimal(price) / 1_000_000).cast("decimal(10,8)")
        cost = cost + F.col(c).cast("decimal(20,0)") * per_token
    return sums.withColumn("cost", cost.cast("decimal(30,8)"))


def capped_steps(steps: DataFrame, key: str = "session_id", order: str = "step_ts", tie: str = "event_id",
                 max_steps: int = fixed.MAX_STEPS) -> DataFrame:
    """The first `max_steps` steps of each session, numbered, with a flag for capped sessions."""
    if max_steps <= GROUP_LIMIT:
        kept = first_rows(steps, [key], [F.col(order), F.col(tie)], max_steps, "step")
    else:  # too many for a cut before the shuffle: hot sessions are sliced instead
        kept = OrderedGroups(steps, [key], [order, tie]).row_number("step").result().where(F.col("step") <= max_steps)
    capped = steps.groupBy(key).agg((F.count(F.lit(1)) > max_steps).alias("capped"))
    return kept.join(capped, key)


def thread_starts(messages: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """messages(conv_id, turn, role): per conversation whether the next goal starts a fresh thread.

    It does when the last message is from the user; breaks counts user messages
    that follow a user message inside the thread.
    """
    seen = OrderedGroups(messages, ["conv_id"], ["turn"], max_rows).lag(F.col("role"), "before").result()
    broken = (F.col("role") == "user") & (F.col("before") == "user")
    return seen.groupBy("conv_id").agg(
        F.max_by("role", "turn").alias("last_role"),
        (F.max_by("role", "turn") == "user").alias("fresh"),
        F.count_if(broken).alias("breaks"),
    )


def idle_sessions(log: DataFrame, gap_s: int = fixed.IDLE_GAP_S, key: str = "session_id",
                  max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Stretches of events without a silence of `gap_s` or more: key, stretch, started, ended, events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = log.select(key, "event_id", "ts", micros.alias("at"))
    spaced = OrderedGroups(timed, [key], ["ts", "event_id"], max_rows).lag(F.col("at"), "prior")
    opens = F.when(F.col("prior").isNull() | (F.col("at") - F.col("prior") >= gap_s * 1_000_000), 1).otherwise(0)
    numbered = spaced.then(opens=opens).running_sum(F.col("opens"), "stretch").result()
    return numbered.groupBy(key, "stretch").agg(
        F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("events")
    )


def event_counts(log: DataFrame, width: str = "1 hour") -> DataFrame:
    return log.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "kind", "n"
    )
