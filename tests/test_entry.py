"""The driver's contract holds without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TOP = ["__spark_entry__.py", "corpus_pipeline.py"]


@pytest.mark.parametrize("gone", [["boutline/llm", "corpus_pipeline.py"], ["boutline/llm"], ["corpus_pipeline.py"]])
def test_entry_without_added_operators(tmp_path, gone):
    shutil.copytree(ROOT / "boutline", tmp_path / "boutline", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "boutline/llm" in gone else [])))
    for name in TOP:
        if name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q) and callable(e.entry); print(sum(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    if "boutline/llm" in gone:
        assert int(out.stdout) == len([n for n in ("openings", "openings_summary", "opponent_habits")])
