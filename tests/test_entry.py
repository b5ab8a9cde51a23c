"""The driver's contract, and independence of the llm parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_llm_parts():
    for path in (ROOT / "marlstone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            text = path.read_text()
            assert "marlstone.llm" not in text and "from .llm" not in text and "from ..llm" not in text, path


def test_works_without_the_llm_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
