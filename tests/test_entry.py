"""The library without its training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "shiftledger", tmp_path / "shiftledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()))"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120,
    )
    assert said.returncode == 0, said.stderr
    count, same = said.stdout.split()
    assert int(count) >= 108 and same == "True"


def test_nothing_else_imports_that_part():
    for file in (ROOT / "shiftledger").rglob("*.py"):
        if "llm" not in file.parts:
            assert "shiftledger.llm" not in file.read_text(), file
