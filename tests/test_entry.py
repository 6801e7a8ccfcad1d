"""The driver's entry with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

CALL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [("markbook/llm", "tests/llm", "corpus_pipeline.py"), ("markbook/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    home = tmp_path / "repo"
    shutil.copytree(ROOT, home, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(home / name) if (home / name).is_dir() else (home / name).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CALL], cwd=home, env=env, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    n, _, with_ops = got.stdout.split()
    assert int(n) >= 80 and (with_ops == "True") == ((home / "markbook/llm/queries.py").exists())


def test_a_needed_checkpoint_folder_is_not_made_up_on_a_cluster():
    from markbook.session import own_folder

    assert os.path.isdir(own_folder("local[4]"))
    with pytest.raises(ValueError):
        own_folder("spark://host:7077")
