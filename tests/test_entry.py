"""The registry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [("fleetctx/llm", "tests/llm"), ("fleetctx/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else Path.unlink)(copy / name, *([True] if (copy / name).is_dir() else []))
        assert not (copy / name).exists()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=copy, capture_output=True, text=True, check=True).stdout.splitlines()
    queries = said[0].split()
    assert "active_builds" in queries and "pipeline" not in queries and set(said[1].split()) <= set(queries)
    assert any(q.startswith("op1_") for q in queries) == ("fleetctx/llm" not in gone and (ROOT / "fleetctx/llm").exists())


def test_nothing_else_imports_the_operators():
    own = [p for p in (ROOT / "fleetctx").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "llm" in p.read_text(encoding="utf-8")]
