"""The library and its entry work without the optional training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100 and not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q)"


def test_entry_without_the_optional_part(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", check=True, timeout=120)


def test_the_other_tests_run_without_the_optional_part(tmp_path):
    """All other test files are collected and a few run in a copy without both folders."""
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse", "test_alone.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=600)
    seen = run("--collect-only", "tests")
    assert seen.returncode == 0 and "error" not in seen.stdout.lower().splitlines()[-1], seen.stdout[-2000:]
    some = run("tests/test_oracles.py", "-k", "haversine or without")
    assert some.returncode == 0, some.stdout[-2000:]


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "lodestar").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", path.read_text(), re.M), path
