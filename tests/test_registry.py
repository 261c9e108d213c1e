"""The registry with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as E; print(*sorted(E.queries())); print(*sorted(E.oracle_sql()))"


def names(folder: Path) -> tuple[set, set]:
    found = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True, timeout=120)
    a, b = found.stdout.strip().splitlines()
    return set(a.split()), set(b.split())


@pytest.mark.parametrize("gone", [(), ("laglake/llm", "tests/llm"), ("laglake/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_subpackage(tmp_path, gone):
    for item in ("laglake", "__spark_entry__.py", "corpus_pipeline.py"):
        at = ROOT / item
        if at.is_dir():
            shutil.copytree(at, tmp_path / item, ignore=lambda d, inside: [x for x in inside if x == "__pycache__" or f"{Path(d).relative_to(ROOT)}/{x}" in gone])
        elif at.exists() and item not in gone:
            shutil.copy(at, tmp_path / item)
    queries, sql = names(tmp_path)
    assert {"chrono_split", "gram_lagcov", "fill_date"} <= sql <= queries
    there = not gone and (ROOT / "laglake/llm").exists()
    assert any(q.startswith("op") and q[2].isdigit() for q in queries) == there
    if not there:
        assert "pipeline" not in queries


def test_the_library_does_not_import_the_subpackage():
    for path in (ROOT / "laglake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "laglake.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
