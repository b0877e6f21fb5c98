"""Writers: run state, converted trees, partition overwrite, appends, exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift import fixed
from loomshift.functions import hive


def balanced(df: DataFrame, partition_columns: Sequence[str]) -> DataFrame:
    """Rows of a partition folder brought together, so that tasks do not each write a
    small file to every folder; adaptive execution splits folders that are too large."""
    if not partition_columns:
        return df
    names = ", ".join(f"`{c}`" for c in partition_columns)
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({names}) */ * FROM {{rows}}", rows=df)


def _partition_columns(df: DataFrame, table: str) -> list[str]:
    return [c.name for c in df.sparkSession.catalog.listColumns(table) if c.isPartition]


def write_state(conversions: DataFrame, path: str) -> None:
    conversions.write.mode("overwrite").parquet(path)


def write_converted(converted: DataFrame, path: str) -> None:
    """The converted corpus as one table, a folder per file type."""
    write_partitioned(converted, path, ["file_type"])


def write_partitioned(df: DataFrame, path: str, partition_columns: Sequence[str]) -> None:
    balanced(df, partition_columns).write.mode("overwrite").partitionBy(*partition_columns).parquet(path)


def overwrite_partitions(df: DataFrame, table: str) -> None:
    """INSERT OVERWRITE with dynamic partitions: only the partitions in `df` are replaced.

    Columns are matched by name.
    """
    spark = df.sparkSession
    parts = _partition_columns(df, table)
    rows = balanced(df.select(*spark.table(table).columns), parts)
    # the mode is an option of this write, which an insert into the table would take from the session
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(location(spark, table))
    spark.catalog.recoverPartitions(table)
    spark.catalog.refreshTable(table)


def location(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]


def detached(spark: SparkSession, table: str) -> DataFrame:
    """The rows of an external table without its entry in the catalog, which is dropped."""
    rows = spark.read.schema(spark.table(table).schema).parquet(location(spark, table))
    spark.sql(f"DROP TABLE {table}")
    return rows


def append_rows(df: DataFrame, table: str) -> None:
    rows = df.select(*df.sparkSession.table(table).columns)
    balanced(rows, _partition_columns(df, table)).write.insertInto(table)


def write_formatted(df: DataFrame, path: str, storage: str, delimiter: str = "\x01") -> None:
    if storage == "textfile":
        df.write.mode("overwrite").options(sep=delimiter, nullValue="\\N", header="false", quote="", escape="\\").csv(path)
    else:
        df.write.mode("overwrite").format(storage).save(path)


def export_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes are doubled, so any text comes back whole."""
    df.write.mode("overwrite").options(header="true", escape='"').csv(path)


def provision(spark: SparkSession, table: str, schema: T.StructType, location: str,
              partition_columns: Sequence[str] = (), comment: str = "", replace: bool = True) -> None:
    """Drop and create a table with mapped types, kept at a location."""
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    fields = ", ".join(f"`{f.name}` {hive.widened(f.dataType).simpleString()}" for f in schema)
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_columns)})" if partition_columns else ""
    quoted = comment.replace("\\", "\\\\").replace('"', '\\"')
    spark.sql(
        f'CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet{parts} LOCATION "{location}" COMMENT "{quoted}"'
    )


# --- strict inserts -------------------------------------------------------------


def insert_cast(source: T.StructField, target: T.DataType | None, lenient: bool = True) -> Column:
    """A column cast for its target; without a known target, time-like names become STRING."""
    name = source.name
    if target is None:
        if any(name.endswith(e) for e in fixed.STRING_ENDINGS):
            return F.col(name).cast("string").alias(name)
        return F.col(name)
    # nullability aside
    if hive.widened(source.dataType).simpleString() == target.simpleString():
        return hive.to_target(name, source.dataType)
    cast = F.col(name).try_cast(target) if lenient else F.col(name).cast(target)
    return cast.alias(name)


def coerce(df: DataFrame, target: T.StructType, lenient: bool = True) -> DataFrame:
    """Columns cast to the target schema, in its order."""
    return df.select(*[insert_cast(df.schema[f.name], f.dataType, lenient) for f in target])


def coerce_by_name(df: DataFrame, known: Mapping[str, T.DataType]) -> DataFrame:
    return df.select(*[insert_cast(f, known.get(f.name)) for f in df.schema])


def cast_audit(df: DataFrame, target: Mapping[str, T.DataType]) -> DataFrame:
    """Per column: values, and values that the cast would turn into NULL.  One pass."""
    entries = []
    for name, dtype in target.items():
        lost = F.col(name).isNotNull() & F.col(name).try_cast(dtype).isNull()
        entries.append(
            F.struct(
                F.lit(name).alias("column_name"), F.lit(dtype.simpleString()).alias("target_type"),
                F.count(name).alias("non_null"), F.count_if(lost).alias("lost"),
            )
        )
    return df.agg(F.array(*entries).alias("x")).select(F.inline("x"))
