"""The library and its entry import without the subpackage of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports(tmp_path, pipeline):
    gone = ["llm", "__pycache__", ".git", "spark-warehouse"] + ([] if pipeline else ["corpus_pipeline.py"])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone))
    ran = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    names = ran.stdout.split()
    assert "d1_annual_means" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_other_missing_modules_are_errors(tmp_path):
    shutil.copytree(ROOT / "verdancy", tmp_path / "verdancy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    ran = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=tmp_path, capture_output=True, text=True)
    assert ran.returncode != 0 and "no_such_module" in ran.stderr
