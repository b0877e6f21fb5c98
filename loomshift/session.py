"""Session settings and the shared scratch folder.

Queries get a session from their caller.  `configure` sets only the runtime SQL
options the results depend on, and `scratch` hands out a fresh folder below the
shared checkpoint folder of the session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # a literal ${name} in a SQL text must survive
    "spark.sql.variable.substitute": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # streaming state larger than memory goes to disk
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # sessions of one key meet in each task before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_OPTIONS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# Input bytes per shuffle partition before adaptive execution merges small ones.
BYTES_PER_PARTITION = 256 * 1024 * 1024
MAX_PARTITIONS = 20_000
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _bytes_below(spark: SparkSession, path: str) -> int:
    """Size of the files below a path, told by the file system without a job."""
    target, system = _hadoop(spark, path)
    return system.getContentSummary(target).getLength()


# The number set for the query before, by application; another number is the user's own.
_sized: dict[str, str] = {}
# Bytes of the tables that the query being built has read so far, by application and path.
_inputs: dict[str, dict[str, int]] = {}
# Sizes looked up before, by path and modification time.
_known: dict[tuple[str, int], int] = {}


def begin_sizing(spark: SparkSession) -> None:
    """From now on the tables read set the shuffle width, until `end_sizing`; a number the user set is kept."""
    app = spark.sparkContext.applicationId
    now = spark.conf.get(INITIAL_PARTITIONS, None)
    if now is not None and now == _sized.get(app):
        spark.conf.unset(INITIAL_PARTITIONS)
    _inputs[app] = {}


def end_sizing(spark: SparkSession) -> None:
    _inputs.pop(spark.sparkContext.applicationId, None)


def size_shuffles(spark: SparkSession, path: str) -> None:
    """Counts a table towards the initial shuffle partitions of the query being built."""
    app = spark.sparkContext.applicationId
    now = spark.conf.get(INITIAL_PARTITIONS, None)
    if app not in _inputs or path in _inputs[app] or (now is not None and now != _sized.get(app)):
        return
    target, system = _hadoop(spark, path)
    key = (path, system.getFileStatus(target).getModificationTime())
    if key not in _known:
        _known[key] = _bytes_below(spark, path)
    _inputs[app][path] = _known[key]
    wanted = min(sum(_inputs[app].values()) // BYTES_PER_PARTITION, MAX_PARTITIONS)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        _sized[app] = str(wanted)
        spark.conf.set(INITIAL_PARTITIONS, _sized[app])


def build(app: str = "loomshift", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_OPTIONS, **options}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the cluster. Where none is set, a session on one machine
    gets a temporary one; on a cluster its executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="loomshift-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file:" + own
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


# The folder of each application below the shared one.
_roots: dict[tuple[str, str], str] = {}


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder of this application; all of them go when it ends, or by `release`."""
    key = (spark.sparkContext.applicationId, shared_folder(spark))
    if key not in _roots:
        root = f"{key[1]}/loomshift-{uuid.uuid4().hex[:12]}"
        path, system = _hadoop(spark, root)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _roots[key] = root
    return f"{_roots[key]}/{label}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Removes what queries of this application have stored; their results can't be read any more."""
    for key in [k for k in _roots if k[0] == spark.sparkContext.applicationId]:
        path, system = _hadoop(spark, _roots.pop(key))
        system.delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the scratch folder and read back: for a narrow result that several
    branches of a query read, so the wide input behind it is scanned once."""
    folder = scratch(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    size_shuffles(spark, path)
    return spark.read.parquet(path)
