"""Rules over tables of rows: the ingest filter and count reconciliation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift import fixed


def ingest_filter(shipments: DataFrame, min_value: Decimal = Decimal(fixed.MIN_DECLARED_VALUE)) -> DataFrame:
    """Rows worth loading; a NULL record type is kept, a NULL value counts as 0."""
    kept = ~F.col("record_type").isin(fixed.EXCLUDED_RECORDS) | F.col("record_type").isNull()
    value = F.coalesce(F.col("declared_value"), F.lit(0).cast("decimal(18,2)"))
    carrier = F.col("carrier_id").isNotNull() & (F.col("carrier_id") != "")
    status = F.col("shipment_status_code").isin(fixed.STATUS_CODES)
    return shipments.where(kept & status & (value >= F.lit(min_value)) & carrier)


def reconcile_counts(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows per key on both sides and their difference."""
    s = source.groupBy(key).agg(F.count("*").alias("s"))
    t = target.groupBy(key).agg(F.count("*").alias("t"))
    left, right = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    return s.join(t, key, "full").select(
        key, left.alias("source_count"), right.alias("target_count"), (left - right).alias("diff")
    )
