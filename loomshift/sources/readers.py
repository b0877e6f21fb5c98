"""Readers: file trees, run state documents, Hive table formats, event logs."""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomshift.functions import text
from loomshift.session import stored

# task functions travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_FILE = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("output_path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("notes", T.ArrayType(T.StringType())),
        T.StructField("validation_passed", T.BooleanType()),
        T.StructField("validation_error", T.StringType()),
    ]
)
# pairs of path and text
FAILURES = T.StructField("failures", T.ArrayType(T.ArrayType(T.StringType())))
STATE = T.StructType(
    [
        T.StructField("repo_path", T.StringType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("files", T.ArrayType(STATE_FILE)),
        T.StructField("bq", T.StructType([T.StructField("passed", T.LongType()), FAILURES])),
        T.StructField(
            "tests",
            T.StructType(
                [
                    T.StructField("ran", T.BooleanType()),
                    T.StructField("passed", T.LongType()),
                    T.StructField("failed", T.LongType()),
                    T.StructField("errors", T.LongType()),
                    FAILURES,
                ]
            ),
        ),
        T.StructField("broken", T.StringType()),
    ]
)


def scan_files(spark: SparkSession, root: str, underscored: bool = True) -> DataFrame:
    """Every file below a folder: path, rel_path, size, content (bad bytes replaced).

    Spark's file sources skip names that start with an underscore, which code
    repositories use (`__init__.py`); `underscored` reads those beside the others.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    if underscored:
        raw = raw.unionByName(_underscored_files(spark, root))
    return raw.select(
        "path", _below(root).alias("rel_path"),
        F.col("length").alias("size"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def _below(root: str) -> Column:
    """The part of `path` below a folder, compared without scheme and host, whichever file system lists them."""
    place = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"
    prefix = re.sub(place, "", root).rstrip("/") + "/"
    return F.substr(F.regexp_replace("path", place, ""), F.lit(len(prefix) + 1))


def list_files(spark: SparkSession, root: str, underscored: bool = True) -> DataFrame:
    """A row per file below a folder: path, rel_path, size. No file is opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    if underscored:
        raw = raw.unionByName(_listed(spark, root))
    return raw.select("path", _below(root).alias("rel_path"), F.col("length").alias("size"))


def open_files(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """The files of some rows of `list_files`, with their content as in `scan_files`; tasks open just these, spread by path."""
    content = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    read = listed.select("path", "rel_path").repartition("path").mapInPandas(_opener(root), "path string, length long, content binary")
    return read.select("path", _below(root).alias("rel_path"), F.col("length").alias("size"), content)


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", root)))


def _skipped_by_spark(rel_path: str) -> bool:
    parts = rel_path.split("/")
    return any(p.startswith("_") and "=" not in p for p in parts) and not any(p.startswith(".") for p in parts)


READ_BYTES = 32 * 1024 * 1024  # file contents handed on at a time


def _opener(root: str):
    """Task function that reads the files named by `path` and, below the folder, by `rel_path`."""
    base = _file_system(root)[1].rstrip("/")

    def read(batches):
        own, _ = _file_system(root)
        for batch in batches:
            held: list[tuple[str, int, bytes]] = []
            for path, rel_path in zip(batch["path"], batch["rel_path"], strict=True):
                with own.open_input_stream(f"{base}/{rel_path}") as stream:
                    content = stream.readall()
                held.append((path, len(content), content))
                if sum(n for _, n, _ in held) >= READ_BYTES:
                    yield pd.DataFrame(held, columns=["path", "length", "content"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["path", "length", "content"])

    return read


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """Files that Spark's own listing skips: path, length. Tasks list one level of folders after the other, the folders of a level spread anew."""
    base = _file_system(root)[1]

    def entries(batches):
        own, _ = _file_system(root)
        for batch in batches:
            for folder in batch["path"]:
                infos = [i for i in own.get_file_info(fs.FileSelector(folder)) if not i.base_name.startswith(".")]
                yield pd.DataFrame({
                    "path": pd.Series([i.path for i in infos], dtype="object"),
                    "length": pd.Series([i.size or 0 for i in infos], dtype="int64"),
                    "folder": pd.Series([i.type == fs.FileType.Directory for i in infos], dtype="bool"),
                    "skipped": pd.Series([_skipped_by_spark(i.path[len(base):].strip("/")) for i in infos], dtype="bool")})

    level, found = literal_rows(spark, [(base,)], "path string"), None
    while not level.isEmpty():
        listed = stored(level.repartition("path").mapInPandas(entries, "path string, length long, folder boolean, skipped boolean"), "listing")
        files = listed.where("NOT folder AND skipped").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = listed.where("folder").select("path")
    return found


def _underscored_files(spark: SparkSession, root: str) -> DataFrame:
    """The files that Spark's own listing skips, read by tasks."""
    listed = _listed(spark, root).select("path", _below(root).alias("rel_path"))
    return listed.repartition("path").mapInPandas(_opener(root), "path string, length long, content binary")


def state_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run state documents; corrupt ones are left out, an absent path gives none."""
    reader = spark.read.schema(STATE).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord="broken", multiLine=str(multi_line).lower()
    )
    try:
        docs = reader.json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        docs = spark.createDataFrame([], STATE)
    return docs.where(F.col("broken").isNull()).drop("broken")


def state_files(documents: DataFrame) -> DataFrame:
    rows = documents.select("repo_path", "output_dir", F.explode("files").alias("f"))
    return rows.select("repo_path", "output_dir", "f.*")


def state_failures(documents: DataFrame, stage: str) -> DataFrame:
    """Failures recorded for a stage (bq or tests): output_dir, rel_path, error."""
    rows = documents.select("output_dir", F.explode(f"{stage}.failures").alias("f"))
    return rows.select("output_dir", F.get("f", F.lit(0)).alias("rel_path"), F.get("f", F.lit(1)).alias("error"))


def state_test_counts(documents: DataFrame) -> DataFrame:
    return documents.where("tests.ran").select("output_dir", "tests.passed", "tests.failed", "tests.errors")


def read_state(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """File rows of run state documents; a corrupt document gives no rows."""
    return state_files(state_documents(spark, path, multi_line))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "\x01") -> DataFrame:
    """Hive delimited text: no header, \\N for NULL."""
    return spark.read.schema(schema).options(sep=delimiter, nullValue="\\N", header="false", quote="", escape="\\").csv(path)


def read_formatted(spark: SparkSession, path: str, schema: T.StructType, storage: str) -> DataFrame:
    if storage == "textfile":
        return read_delimited(spark, path, schema)
    return spark.read.schema(schema).format(storage).load(path)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType, partition_columns: Sequence[str]) -> DataFrame:
    """Partition columns keep the type of the schema (STRING stays STRING)."""
    missing = set(partition_columns) - set(schema.fieldNames())
    if missing:
        raise ValueError(f"partition columns without a type: {sorted(missing)}")
    return spark.read.schema(schema).parquet(path)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small frame from rows in the program; Arrow keeps it free of Python tasks."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)


EVENT = (
    "kind string, session string, id string, name string, ok boolean, preview string, label string, "
    "tool string, decision string, text string, usage string, input string, broken string"
)


def pushed_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from lines of a server push (`data: {...}`), batch or stream.

    Keepalive comments and blank lines are dropped; an event that is no JSON
    stays as a row with its text in `broken`.
    """
    body = F.regexp_extract(column, r"^data: ?(.*)$", 1)
    event = F.from_json(body, EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    others = [c for c in lines.columns if c != column]
    return lines.where(F.startswith(column, F.lit("data:"))).select(*others, event.alias("e")).select(*others, "e.*")


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """An event table, one file or a folder of them, as a stream; a zone-less time becomes a timestamp, as watermarks need."""
    # a stream takes a single file only by a pattern: the last letter as a class of one matches file and folder alike
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    zoneless = [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)]
    return stream.withColumns({n: F.col(n).cast("timestamp") for n in zoneless})


def pushed_chunks(spark: SparkSession, root: str, files_per_batch: int = 1000, closing: str = "event: closed") -> DataFrame:
    """Push logs that land as `session=<id>/chunk=<number>/<file>` below a folder, as a stream of chunks: session_id, chunk, lines
    in file order, and whether the chunk holds the closing line. Any store that Spark reads will do."""
    raw = (spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", files_per_batch).load(root).select("value", F.col("_metadata.file_path").alias("path")))
    lines = text.lines("value")

    def decoded(part):
        return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))

    # the path is encoded as an address, and the folder's name as partition folders are
    session = decoded(decoded(F.regexp_extract("path", r"/session=([^/]*)/chunk=\d+/[^/]*$", 1)))
    return raw.select(
        session.alias("session_id"),
        F.regexp_extract("path", r"/chunk=(\d+)/[^/]*$", 1).cast("long").alias("chunk"), lines.alias("lines"),
        F.array_contains(lines, closing).alias("is_last"))
