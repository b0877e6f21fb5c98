"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomshift import session

# words of the contracts: everything but blank, tab and the line separators
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Task functions of the module travel with the job, so executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out. Null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one where the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Quoted names of the columns, without those that an operator adds."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() not in but]


def ddl(df: DataFrame, *more: str) -> str:
    """Schema of a table with more columns behind its own."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), *more])


class Scratch:
    """Stored tables of one operator run below the shared checkpoint folder.

    A lost executor then costs a read of a table, not the work behind it. `drop` removes
    tables as soon as nothing reads them any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, session.scratch(spark, label), 0

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        folder = f"{self.root}/{self.n}"
        df.write.parquet(folder)
        back = self.spark.read.schema(df.schema).parquet(folder)
        back._folder = folder
        return back

    def drop(self, *tables: DataFrame | str) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table._folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Adds the position in the whole order, from 0. Rows are range partitioned, numbered within
    each part and shifted by the sizes of the parts before, so no task sees all rows."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = scratch.store(df.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id()))
    # one small row per part
    counts = dict(dealt.groupBy("_part").count().collect())
    before, total = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(total)]
        total += counts[part]
    shift = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, (within - 1 + shift).cast("long")).drop("_part")
