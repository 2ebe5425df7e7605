"""The entry module without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_training_data_part(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and int(found.stdout) > 100, found.stderr


def test_errors_of_the_training_data_part_show(tmp_path):
    """A package that an operator needs and that is missing isn't taken for a missing operator."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "llm"))
    (tmp_path / "repo" / "studymill" / "llm").mkdir()
    (tmp_path / "repo" / "studymill" / "llm" / "__init__.py").write_text("")
    (tmp_path / "repo" / "studymill" / "llm" / "queries.py").write_text("import no_such_package\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=120)
    assert found.returncode != 0 and "no_such_package" in found.stderr


def test_the_rest_passes_without_the_training_data_part(tmp_path):
    """Suites that reach every module of the rest, with the two folders gone."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "llm"))
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_text.py", "tests/test_rules.py", "tests/test_operators.py", "tests/test_rewrite.py", "tests/test_retrieval.py"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=3600)
    assert found.returncode == 0, found.stdout[-2000:]
