"""The library without the training-data subpackage, its tests or the pipeline made of it."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = """
import json, sys, __spark_entry__ as driver
print(json.dumps([sorted(driver.queries()), sorted(driver.oracle_sql()), [m for m in sys.modules if ".llm" in m]]))
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".*", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    assert not (copy / "tripflow" / "llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline
    shown = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, check=True, timeout=120)
    names, sql, loaded = json.loads(shown.stdout.splitlines()[-1])
    from tripflow.plans.queries import QUERIES

    assert names == sql == sorted(QUERIES) and loaded == []


def test_nothing_else_imports_it():
    sources = [p for p in (ROOT / "tripflow").rglob("*.py") if "llm" not in p.parts]
    assert sources and not any("tripflow.llm" in p.read_text() for p in sources)
