"""Run state in versions: buckets of rows by the hash of their key, and a list of buckets that is put in place last.

A folder holds `data-<id>/_bucket=<n>` for every write and `version=<n>` for every finished one, a small table (bucket, folder)
that names where each bucket lies. A reader takes the newest version; a merge writes the buckets that its new rows fall into
under a new id and names the old folders for all others, so it can read the state that it replaces, and a failed one leaves
nothing that is read. One writer at a time: a second one that ends later finds its version taken and raises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift.session import _hadoop, stored
from loomshift.sources.readers import literal_rows

BUCKET = "_bucket"
BUCKETS = 256


class Moved(RuntimeError):
    """Another writer has put a version in place since the state was read."""


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions, in order."""
    target, system = _hadoop(spark, root)
    if not system.exists(target):
        return []
    names = [s.getPath().getName() for s in system.listStatus(target)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def _places(spark: SparkSession, root: str, version: int) -> dict[int, str]:
    """Folder of each bucket that has rows: a row per bucket, a number fixed when the state is begun."""
    rows = spark.read.schema("bucket int, folder string").parquet(f"{root}/version={version}").collect()
    return {r.bucket: r.folder for r in rows}


def _read(spark: SparkSession, root: str, schema: T.StructType, places: dict[int, str]) -> DataFrame:
    by_write: dict[str, list[str]] = {}
    for bucket, folder in places.items():
        by_write.setdefault(folder, []).append(f"{root}/{folder}/{BUCKET}={bucket}")
    found = spark.createDataFrame([], schema)
    for paths in by_write.values():
        found = found.unionByName(spark.read.schema(schema).parquet(*sorted(paths)))
    return found


def read(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest one if none is named; an absent state has none."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], schema)
    places = _places(spark, root, known[-1] if version is None else version)
    return _read(spark, root, schema, {b: f for b, f in places.items() if b >= 0})


def _write(rows: DataFrame, root: str) -> tuple[str, list[int]]:
    """Rows with their bucket, stored under a new id: that folder and the buckets it has."""
    folder = f"data-{uuid.uuid4().hex[:12]}"
    hint = f"SELECT /*+ REBALANCE(`{BUCKET}`) */ * FROM {{rows}}"
    spark = rows.sparkSession
    spark.sql(hint, rows=rows).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
    target, system = _hadoop(spark, f"{root}/{folder}")
    names = [s.getPath().getName() for s in system.listStatus(target)]
    return folder, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))


def _commit(spark: SparkSession, root: str, places: dict[int, str], number: int) -> int:
    """Puts a version in place: written beside, renamed as the last step."""
    beside = f"{root}/.next-{uuid.uuid4().hex[:12]}"
    literal_rows(spark, sorted(places.items()), "bucket int, folder string").coalesce(1).write.parquet(beside)
    source, system = _hadoop(spark, beside)
    target, _ = _hadoop(spark, f"{root}/version={number}")
    if system.exists(target) or not system.rename(source, target):
        raise Moved(f"version {number} of {root} is there already")
    return number


def create(rows: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> int:
    """Replaces the whole state: every bucket is new. Gives the number of the version."""
    spark = rows.sparkSession
    number = (versions(spark, root) or [0])[-1] + 1
    folder, written = _write(rows.withColumn(BUCKET, bucket_of(key, buckets)), root)
    # bucket -1 carries the number of buckets
    return _commit(spark, root, {-1: str(buckets), **{b: folder for b in written}}, number)


def merge(new: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> int:
    """New rows replace those with the same key; the others stay, and buckets without a new row stay as they lie. `new` may be
    worked out from the state itself. `buckets` counts only where there is no state yet."""
    spark = new.sparkSession
    known = versions(spark, root)
    if not known:
        return create(new, root, key, buckets)
    places = _places(spark, root, known[-1])
    buckets = int(places[-1])
    fresh = stored(new.withColumn(BUCKET, bucket_of(key, buckets)), "fresh")
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most a row per bucket
    old = _read(spark, root, new.schema, {b: places[b] for b in touched if b in places})
    stay = old.withColumn(BUCKET, bucket_of(key, buckets)).join(fresh.select(key).distinct(), key, "left_anti")
    folder, written = _write(stay.unionByName(fresh), root)
    kept = {b: f for b, f in places.items() if b not in touched}
    return _commit(spark, root, {**kept, **{b: folder for b in written}}, known[-1] + 1)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes versions but the newest `keep`, and the stored rows that no version left names. Not while a merge runs."""
    known = versions(spark, root)
    used = {f for v in known[-keep:] for f in _places(spark, root, v).values()}
    target, system = _hadoop(spark, root)
    gone = []
    for status in system.listStatus(target):
        name = status.getPath().getName()
        old = name.startswith("version=") and int(name.split("=")[1]) in known[:-keep]
        if old or (name.startswith("data-") and name not in used):
            system.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
