"""The registry without the training-data folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'profile_numbers' in q; print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [["inkspan/llm", "tests/llm"], ["inkspan/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_folders(tmp_path, gone):
    for p in ("inkspan", "tests"):
        shutil.copytree(HERE / p, tmp_path / p, ignore=shutil.ignore_patterns("__pycache__"))
    for p in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / p).exists():
            shutil.copy(HERE / p, tmp_path)
    for p in gone:
        if (tmp_path / p).is_dir():
            shutil.rmtree(tmp_path / p)
        elif (tmp_path / p).exists():
            (tmp_path / p).unlink()
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, operators = out.stdout.split()
    assert pipeline == "False" and (operators == "False" or "inkspan/llm" not in gone)


def test_a_pipeline_elsewhere_on_the_path_does_not_count(tmp_path):
    shutil.copytree(HERE / "inkspan", tmp_path / "inkspan", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "corpus_pipeline.py").write_text("run, ORACLE_SQL = None, None\n")
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path / "other")}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False"
