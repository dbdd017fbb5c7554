"""The driver's contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "monthly_quantiles" in e.queries()


def test_entry_without_the_llm_folders(tmp_path):
    """The module still imports, with the other queries, once the folders and the pipeline are gone."""
    shutil.copytree(ROOT / "tidegrid", tmp_path / "tidegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert 'pipeline' not in n and not any(x.startswith('op1') for x in n) and 'zonal_stats' in n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
