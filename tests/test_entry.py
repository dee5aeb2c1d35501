"""The driver contract holds with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

SAYS = """
import __spark_entry__ as e
print(len(e.queries()), any(n.startswith("op") or n == "pipeline" for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """In a copy without the two folders, with and without the pipeline module."""
    copy = tmp_path / "copy"
    left_out = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=left_out)
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 90 and said[1:] == ["False", "True"]


def test_twins_belong_to_queries():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
