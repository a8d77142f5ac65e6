"""The entry works without the numbered operators' subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_without_the_subpackage(tmp_path):
    shutil.copytree(REPO / "herald", tmp_path / "herald", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for extra in (False, True):
        if extra and (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", tmp_path)  # it alone is not enough
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
