"""The entry lists all training-data queries, or fails aloud."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)


def test_a_faulty_import_is_raised():
    got = run("import muniprop.llm.common as c; del c.Query; import __spark_entry__")
    assert got.returncode and "cannot import name 'Query'" in got.stderr


def test_all_are_listed():
    got = run("import __spark_entry__ as e; print(len(e.LLM_QUERIES))")
    assert got.stdout.split()[-1] == "14", got.stderr
