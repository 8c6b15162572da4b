"""The entry module is read before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_queries_and_sql_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 60; print('listed')"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.stdout.split()[-1:] == ["listed"], done.stderr[-500:]
