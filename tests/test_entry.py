import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "l_orderkey" in df.columns


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_full' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')] and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_package_that_the_optional_folder_needs_is_missing():
    code = "import sys; sys.modules['pandas'] = None; import __spark_entry__ as e; q = e.queries(); assert 'scan_full' in q and 'pipeline' not in q, q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0 and (not os.path.isdir(f"{ROOT}/tessera/llm") or "left out" in done.stderr), done.stderr
