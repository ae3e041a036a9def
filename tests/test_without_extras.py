"""The library and its registered queries without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = """
import sys
import __spark_entry__ as driver
from quillvec.plans.registry import ORACLES, QUERIES
assert set(driver.queries()) == set(QUERIES) and set(driver.oracle_sql()) == set(ORACLES)
assert len(QUERIES) >= 65 and not any(m.startswith("quillvec.llm") for m in sys.modules)
"""


@pytest.mark.parametrize("gone", [{"llm"}, {"llm", "corpus_pipeline.py"}])
def test_queries_without_the_subpackage(tmp_path, gone):
    shutil.copytree(os.path.join(ROOT, "quillvec"), tmp_path / "quillvec", ignore=lambda d, names: gone & set(names))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - gone:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
