"""The entry with and without its optional parts."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), len([n for n in q if n.startswith('op')]), 'pipeline' in q)"


def run(before=""):
    return subprocess.run([sys.executable, "-c", before + COUNT], cwd=ROOT, capture_output=True, text=True, check=True)


@pytest.mark.parametrize("hidden", ["zstandard", "tidemark.llm", "corpus_pipeline"])
def test_a_missing_part_takes_only_its_queries(hidden):
    from tidemark.plans.queries import QUERIES

    got = run(f"import sys; sys.modules[{hidden!r}] = None; ")
    n, ops, pipeline = got.stdout.split()
    assert int(n) == len(QUERIES) and pipeline == "False" and "left out" in got.stderr and (ops == "0" or hidden == "corpus_pipeline")
