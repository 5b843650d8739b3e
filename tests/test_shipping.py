"""Queries with Python functions run from any folder: the package reaches the workers by itself."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from newsweave.session import build_session
spark = build_session("local[2]", 2)
print("ROWS", entry.queries()["enrich_stub"](spark, sys.argv[2]).count())
"""


def test_queries_run_from_another_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
