import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from corvane.plans import catalogue

ROOT = Path(__file__).parent.parent


def test_queries_and_oracles_agree_in_name():
    have = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(have) and set(catalogue.QUERIES) <= set(have)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["term", "cnt"]


def test_the_rest_stands_without_the_llm_subpackage(tmp_path):
    for name in ("corvane", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "corvane" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; from corvane.plans.catalogue import QUERIES as q; assert set(e.queries()) == set(q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "corvane.llm" not in p.read_text(), p
