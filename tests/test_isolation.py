"""The core without the training-data subpackage, its tests and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from cairn.plans import registry

HERE = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(e.queries())[0])"


@pytest.mark.parametrize("gone", [["cairn/llm", "tests/llm"], ["cairn/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_core_stands_alone(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True)
        path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    n, checked = map(int, out.stdout.split()[:2])
    if "cairn/llm" in gone:
        assert (n, checked) == (len(registry.queries()), len(registry.oracle_sql()))
    else:
        assert n >= len(registry.queries())
