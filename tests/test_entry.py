"""The entry module without the text operators, whatever is left of their folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), sum(n[:2] == 'op' or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def counted(folder: Path, before: str = "") -> list[str]:
    out = subprocess.run([sys.executable, "-c", before + COUNT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return out.stdout.split()


@pytest.fixture
def copy(tmp_path):
    for name in ("fluxlens", "workload"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_folder_and_pipeline_deleted(copy):
    total, text, consistent = counted(copy)
    assert int(total) > 90 and text == "0" and consistent == "True"


def test_empty_folder_left_over(copy):
    (copy / "fluxlens" / "llm" / "__pycache__").mkdir(parents=True)
    assert counted(copy)[1:] == ["0", "True"]


def test_library_absent(copy):
    """A finder that refuses a library stands for one that is not installed."""
    absent = "import sys; sys.modules['zstandard'] = None; "
    if (ROOT / "fluxlens" / "llm").is_dir():
        shutil.copytree(ROOT / "fluxlens" / "llm", copy / "fluxlens" / "llm")
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
    total, text, consistent = counted(copy, absent)
    assert int(total) > 90 and text == "0" and consistent == "True"
