"""The entry is read by a driver that may keep Spark elsewhere."""

import subprocess
import sys
from pathlib import Path

from paperweave.functions.text import STOP_WORDS


def test_entry_needs_no_files_beside_pyspark(tmp_path):
    code = f"import pyspark; pyspark.__file__ = {str(tmp_path / '__init__.py')!r}; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n_queries, n_sql = map(int, done.stdout.split()[-2:])
    assert n_queries >= n_sql > 50


def test_stop_words_are_distinct_and_lower_case():
    assert len(set(STOP_WORDS)) == len(STOP_WORDS) == 314
    assert all(w == w.lower() and w.isalpha() for w in STOP_WORDS)
