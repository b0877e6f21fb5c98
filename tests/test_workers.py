"""Python tasks must run where the package is not installed."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from loomshift import session
from loomshift.operators import extract
from loomshift.sources import readers
spark = session.build("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
found = readers.scan_files(spark, {folder!r})
print(sorted(tuple(r) for r in extract.python_syntax(found).collect()))
"""


def test_workers_need_no_copy(tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "__init__.py").write_text("x = 1")
    (tmp_path / "tree" / "bad.py").write_text("x = = 1")
    script = SCRIPT.format(repo=str(Path(__file__).resolve().parent.parent), folder=str(tmp_path / "tree"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    # a gateway of a session that already runs is not for the other process
    env = {k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "('__init__.py', 'python', None), ('bad.py', 'python', 'SyntaxError: invalid syntax (line 1)')" in out.stdout, out.stderr[-2000:]
