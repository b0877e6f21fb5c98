"""State in versions: merges over their own input, failed tasks, untouched buckets, competing writers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomshift.session import scratch
from loomshift.sources import versions

SCHEMA = "rel_path string, status string, n int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_over_its_own_input(spark):
    root = scratch(spark, "state")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert versions.read(spark, root, schema).isEmpty()
    first = spark.range(200).select(F.format_string("f%03d", "id").alias("rel_path"), F.lit("old").alias("status"), F.col("id").cast("int").alias("n"))
    assert versions.create(first, root, "rel_path", buckets=16) == 1
    state = versions.read(spark, root, schema)
    assert rows_of(state) == rows_of(first)
    # worked out from the state that it replaces, with a new key and a null one
    again = state.where("n < 3").withColumn("status", F.lit("new"))
    extra = spark.createDataFrame([("g", "new", 1), (None, "new", 2)], SCHEMA)
    assert versions.merge(again.unionByName(extra), root, "rel_path") == 2
    want = rows_of(first.withColumn("status", F.when(F.col("n") < 3, "new").otherwise("old")).unionByName(extra))
    assert rows_of(versions.read(spark, root, schema)) == want
    assert rows_of(versions.read(spark, root, schema, version=1)) == rows_of(first)
    before, after = versions._places(spark, root, 1), versions._places(spark, root, 2)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 5 and len(after) > 10


def test_failed_merge_leaves_the_state(spark):
    root = scratch(spark, "state")
    first = spark.createDataFrame([(f"f{k}", "old", k) for k in range(20)], SCHEMA)
    versions.create(first, root, "rel_path", buckets=4)
    state = versions.read(spark, root, first.schema)
    broken = state.withColumn("status", F.when(F.col("n") == 13, F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(PySparkException):
        versions.merge(broken, root, "rel_path")
    assert versions.versions(spark, root) == [1] and rows_of(versions.read(spark, root, first.schema)) == rows_of(first)
    # an empty merge is a version that names the same folders
    assert versions.merge(first.limit(0), root, "rel_path") == 2
    assert versions._places(spark, root, 1) == versions._places(spark, root, 2)


def test_second_writer_is_told_and_old_rows_go(spark):
    root = scratch(spark, "state")
    first = spark.createDataFrame([("a", "old", 1), ("b", "old", 2), ("a", "twice", 3)], SCHEMA)
    versions.create(first, root, "rel_path", buckets=2)
    versions.merge(spark.createDataFrame([("a", "new", 1)], SCHEMA), root, "rel_path")
    with pytest.raises(versions.Moved):
        versions._commit(spark, root, {-1: "2"}, 2)
    versions.merge(spark.createDataFrame([("a", "newer", 1), ("b", "newer", 1)], SCHEMA), root, "rel_path")
    gone = versions.prune(spark, root, keep=1)
    assert "version=1" in gone and "version=2" in gone and sum(n.startswith("data-") for n in gone) == 2
    assert rows_of(versions.read(spark, root, first.schema)) == [("a", "newer", 1), ("b", "newer", 1)]
