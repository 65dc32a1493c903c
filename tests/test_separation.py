"""The repository without the optional subpackage: the rest imports and has its queries."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; from colsieve.plans import registry as r; assert set(e.queries()) == set(r.QUERIES) and e.oracle_sql() == r.ORACLE_SQL; print(len(e.queries()))"


@pytest.fixture
def rest(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis", "spark-warehouse", "llm", "*.json", "*.txt")
    return shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)


def run(rest, code):
    return subprocess.run([sys.executable, "-c", code], cwd=rest, env=os.environ | {"PYTHONPATH": str(rest)}, capture_output=True, text=True)


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_llm_folders(rest, pipeline):
    if not pipeline:
        (rest / "corpus_pipeline.py").unlink(missing_ok=True)
    done = run(rest, SHOW)
    assert done.returncode == 0 and int(done.stdout) > 40, done.stderr


def test_other_import_errors_are_raised(rest):
    (rest / "colsieve" / "llm").mkdir()
    (rest / "colsieve" / "llm" / "__init__.py").write_text("")
    (rest / "colsieve" / "llm" / "queries.py").write_text("import surely_not_there")
    (rest / "corpus_pipeline.py").unlink(missing_ok=True)
    done = run(rest, SHOW)
    assert done.returncode and "surely_not_there" in done.stderr
