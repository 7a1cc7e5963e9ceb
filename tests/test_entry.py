import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from sparkloom import catalog

REPO = Path(entry.__file__).resolve().parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) >= 80


def test_the_rest_works_without_the_text_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_flagship_query_has_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["callee", "caller", "dist"] and out.count() > 0
