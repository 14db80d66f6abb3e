"""Without the operators for training data everything else is there and runs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from plantfuse.plans.star_queries import star_queries

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("without_pipeline", [True, False])
def test_queries_without_the_folders(tmp_path, without_pipeline):
    copy = tmp_path / "copy"
    left_out = ["llm", ".git", "__pycache__", ".pytest_cache"]
    if without_pipeline:
        left_out.append("corpus_pipeline.py")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*left_out))
    script = (
        "import __spark_entry__ as e\n"
        "assert 'plantfuse' in e.star_queries.__module__\n"
        "print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["True", str(len(star_queries()))]


def test_nothing_else_imports_them():
    for path in [*ROOT.glob("plantfuse/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "star_sql.py"]:
        if "llm" not in path.parts and path.name != Path(__file__).name:
            assert "plantfuse.llm" not in path.read_text(), path
