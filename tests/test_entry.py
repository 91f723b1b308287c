"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_text_operators(tmp_path):
    """The rest imports and lists its queries where the subpackage and the pipeline are not there."""
    for name in ("__spark_entry__.py", "veritile"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "veritile" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e, veritile; q = e.queries(); print(len(q), len(e.oracle_sql()), [n for n in q if n.startswith('op') or n == 'pipeline'], veritile.__file__)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, with_sql, text, where = said.stdout.split(" ", 3)
    assert int(n) > 60 and int(with_sql) > 60 and text == "[]" and str(tmp_path) in where
