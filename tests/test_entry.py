"""The driver's entry where optional parts are missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNTS = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q), set(s) - set(q)
print(len(q), len(s), sum(x.startswith("op") and x[2].isdigit() for x in q), "pipeline" in q)
"""


@pytest.mark.parametrize("gone", [(), ("strata/llm", "tests/llm"), ("corpus_pipeline.py",), ("strata/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    ran = subprocess.run([sys.executable, "-c", COUNTS], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{copy}:{':'.join(p for p in sys.path if p and Path(p) != ROOT)}"})
    assert ran.returncode == 0, ran.stderr
    n, n_sql, n_llm, pipeline = ran.stdout.split()
    there = (ROOT / "strata/llm").is_dir() and "strata/llm" not in gone
    assert int(n) > 80 and int(n_sql) > 80
    assert (int(n_llm) == 10) == there and (pipeline == "True") == (there and "corpus_pipeline.py" not in gone and (ROOT / "corpus_pipeline.py").exists())
