import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "lexirun").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_rest_works_without_them(tmp_path):
    shutil.copytree(ROOT / "lexirun", tmp_path / "lexirun", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__", "test_separation.py"))
    run = [sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests"]
    subprocess.run([*run, "--collect-only"], cwd=tmp_path, env=env, check=True, timeout=120)
    subprocess.run([*run, "-k", "locate or golden or contract or entry"], cwd=tmp_path, env=env, check=True, timeout=600)


def test_a_broken_import_is_an_error(tmp_path):
    """The guard is for absence: what fails inside the corpus operators must not drop their queries silently."""
    shutil.copytree(ROOT / "lexirun", tmp_path / "lexirun", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    broken = tmp_path / "lexirun" / "llm" / "queries.py"
    if broken.exists():
        broken.write_text("import a_module_that_is_not_there\n")
        found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert found.returncode and "a_module_that_is_not_there" in found.stderr
