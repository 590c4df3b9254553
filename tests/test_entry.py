"""The entry has to work without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_llm_folder(tmp_path, pipeline):
    for name in ("sluiceway", "verification"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = (
        "import __spark_entry__ as e; q = e.queries();"
        " assert len(q) > 30 and not any(n == 'pipeline' or n.startswith('op') for n in q);"
        " assert set(e.oracle_sql()) <= set(q)"
    )
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
