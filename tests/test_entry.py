"""The driver's entry point is imported before there is a Spark session."""

import subprocess
import sys
from pathlib import Path


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr
