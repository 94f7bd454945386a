"""The entry module with and without what the corpus operators need."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["public_tokenizers", "sentencepiece", "weftspark.llm", "corpus_pipeline"])
def test_core_queries_stay_without(missing):
    """A module that cannot be imported takes no other query with it."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(sum(q[0] == 'q' for q in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT}, check=True).stdout.split()
    core = [q for q in entry.queries() if q[0] == "q"]
    assert int(out[0]) == len(core) and int(out[1]) >= sum(q in entry.oracle_sql() for q in core)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
