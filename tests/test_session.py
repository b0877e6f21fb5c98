"""Session options, the shared folder and shuffle sizing."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from loomshift import session


class NamedFolder:
    """A session that names a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return "hdfs://host/shared/" if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_the_one_the_session_names(spark):
    assert session.shared_folder(NamedFolder()) == "hdfs://host/shared"
    # unset here: a folder of our own, the same for the whole session
    assert session.shared_folder(spark) == session.shared_folder(spark)
    assert session.stored(spark.range(5), "kept").count() == 5


def test_shuffles_follow_the_tables_read(spark, tmp_path, monkeypatch):
    for name, n in (("t", 5000), ("u", 5000), ("never_read", 90_000)):
        (tmp_path / f"{name}.parquet").mkdir()
        (tmp_path / f"{name}.parquet" / "part").write_bytes(b"x" * n)
    size = lambda name: session.size_shuffles(spark, f"file:{tmp_path}/{name}.parquet")
    assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 100)
    try:
        # outside of a query nothing is set
        size("t")
        assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
        session.begin_sizing(spark)
        size("t")
        size("t")
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "50"
        size("u")
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "100"
        session.end_sizing(spark)
        # the next query starts anew, also where it reads little
        session.begin_sizing(spark)
        assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
        monkeypatch.setattr(session, "BYTES_PER_PARTITION", 10_000)
        size("t")
        assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
        # a number of the user's own stays
        spark.conf.set(session.INITIAL_PARTITIONS, "7")
        monkeypatch.setattr(session, "BYTES_PER_PARTITION", 100)
        session.begin_sizing(spark)
        size("t")
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "7"
    finally:
        session.end_sizing(spark)
        spark.conf.unset(session.INITIAL_PARTITIONS)


def test_sizing_runs_no_job(spark):
    from loomshift.plans import catalogue

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sizing", "sizing")
    try:
        catalogue.QUERIES["group_count"](spark, "/root/testdata/sf0.001")
        # the footer that tells the schema is all that is read
        assert len(tracker.getJobIdsForGroup("sizing")) <= 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class Cluster:
    """A session on several machines that names no folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())


def test_nothing_stays_behind(tmp_path):
    """What queries store, and the tables they make, go with `release` and with the application."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
import os
import subprocess
import sys
from pathlib import Path

import pytest

from loomshift import session
from loomshift.plans import catalogue
spark = session.build("left", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
    "spark.checkpoint.dir": "file:{tmp_path}/shared", "spark.sql.warehouse.dir": "{tmp_path}/warehouse"}})
for name in ("audit_append", "insert_overwrite_partition", "provision_and_load", "csv_export", "stream_usage"):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
assert spark.catalog.listTables() == []
import os
own = lambda: [f for f in os.listdir("{tmp_path}/shared") if f.startswith("loomshift")]
held = own()
session.release(spark)
print("LEFT", len(held), own())
session.stored(spark.range(3), "late")
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "LEFT 1 []" in out.stdout, out.stderr[-2000:]
    assert not [f for f in os.listdir(tmp_path / "shared") if f.startswith("loomshift")]


def test_a_variable_in_a_text_survives(spark):
    session.configure(spark)
    assert spark.sql("SELECT 'a ${x} b' AS t").first()["t"] == "a ${x} b"
