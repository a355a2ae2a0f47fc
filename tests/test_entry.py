"""The entry points where the optional subpackage, its tests and the pipeline are absent, in part or in whole."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["recollect/llm", "tests/llm"], ["recollect/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_subpackage(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "recollect", tmp_path / "recollect")
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys(); print(*q)"
    told = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}).stdout.split()
    assert "p1_role_split" in told
    assert "pipeline" not in told
    assert any(x.startswith("op") for x in told) == ("recollect/llm" not in gone and (ROOT / "recollect/llm").exists())
