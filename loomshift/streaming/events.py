"""Structured Streaming jobs over an event log (session_id, event_id, ts, kind, ...).

`run_append` and `run_upsert` drive a job over what is there now; a service uses
the same transformations with a processing-time trigger.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift import fixed


def counts(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    grouped = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "kind")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def idle_sessions(stream: DataFrame, gap_s: int, delay: str) -> DataFrame:
    """Sessions closed by a silence, once the watermark has passed it; the session time is open at the end.
    Those still open are the batch sessions that this leaves out."""
    grouped = stream.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", f"{gap_s} seconds").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        "session_id", F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "events"
    )


def permission_outcomes(stream: DataFrame, timeout_s: int = fixed.PERMISSION_TIMEOUT_S,
                        delay: str = "10 minutes") -> DataFrame:
    """Requests with each answer to the same id within the timeout, else deny, once the watermark has passed;
    `first_answers` keeps one row per request."""
    asked = (
        stream.where("kind = 'permission_request'").withWatermark("ts", delay)
        .select("session_id", "id", F.col("event_id").alias("request_id"), F.col("ts").alias("asked_at"))
    )
    said = (
        stream.where("kind = 'permission_resolved'").withWatermark("ts", delay)
        .select(F.col("session_id").alias("s"), F.col("id").alias("i"), F.col("ts").alias("said_at"), "decision")
    )
    in_time = (
        (F.col("session_id") == F.col("s"))
        & (F.col("id") == F.col("i"))
        & (F.col("said_at") >= F.col("asked_at"))
        & (F.col("said_at") <= F.col("asked_at") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS"))
    )
    joined = asked.join(said, in_time, "left_outer")
    return joined.select(
        "session_id", "id", "request_id", "asked_at", "said_at", F.coalesce("decision", F.lit("deny")).alias("decision")
    )


def first_answers(outcomes: DataFrame) -> DataFrame:
    """One row per request of what `permission_outcomes` wrote: the first answer counts, of answers at one time the smallest text."""
    first = F.min(F.struct(F.col("said_at").alias("at"), "decision"))
    return outcomes.groupBy("session_id", "id", "request_id", "asked_at").agg(first["decision"].alias("decision"))


def usage(stream: DataFrame) -> DataFrame:
    """Running token sums per session. State grows with the number of sessions."""
    names = ["input_tokens", "output_tokens", "cache_read", "cache_write"]
    return stream.groupBy("session_id").agg(*[F.sum(n).alias(n) for n in names])


def step_cap(stream: DataFrame, max_steps: int = fixed.MAX_STEPS) -> DataFrame:
    """Steps per session with the cap applied and whether the session was cut or cancelled."""
    n = F.count_if(F.col("kind") == "tool_call")
    return stream.groupBy("session_id").agg(
        F.least(n, F.lit(max_steps)).alias("steps"),
        (n > max_steps).alias("capped"),
        F.coalesce(F.bool_or(F.col("cancelled")), F.lit(False)).alias("cancelled"),
    )


# --- drivers --------------------------------------------------------------------


def run_append(job: DataFrame, folder: str) -> DataFrame:
    """Runs an append-mode job over the data at hand; returns what it wrote."""
    query = (
        job.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return job.sparkSession.read.schema(job.schema).parquet(f"{folder}/out")


def run_upsert(job: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs an update-mode job; the latest row of each key is the result.

    Each micro-batch overwrites its own folder, so a replayed batch changes nothing.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (
        job.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest(job.sparkSession, f"{folder}/out", job, keys)


def latest(spark: SparkSession, folder: str, like: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key; an empty frame while no batch is written."""
    schema = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
    try:
        written = spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        written = spark.createDataFrame([], schema)
    values = [c for c in like.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")
