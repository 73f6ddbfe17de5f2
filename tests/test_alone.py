"""The library without its text subpackage: a copy of the repository that lacks the folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "poi_candidates" in names and "pipeline" not in names
assert not any(n.startswith("op") and n[2].isdigit() for n in names)
assert set(e.oracle_sql()) <= names
"""


def copy_without(tmp_path, *left_out):
    copy = tmp_path / "copy"

    def skip(folder, names):
        inside = os.path.relpath(folder, ROOT)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(inside, n)) in left_out]

    shutil.copytree(ROOT, copy, ignore=skip)
    return copy


def run(copy):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=clean, capture_output=True, text=True)


def test_imports_without_the_text_folders(tmp_path):
    done = run(copy_without(tmp_path, "placeweave/llm", "tests/llm"))
    assert done.returncode == 0, done.stderr


def test_imports_without_the_pipeline_too(tmp_path):
    done = run(copy_without(tmp_path, "placeweave/llm", "tests/llm", "corpus_pipeline.py"))
    assert done.returncode == 0, done.stderr


def test_a_broken_text_module_is_not_hidden(tmp_path):
    copy = copy_without(tmp_path, "tests/llm")
    module = copy / "placeweave" / "llm" / "registry.py"
    if not module.exists():  # the folder is gone already
        return
    module.write_text("import no_such_module_at_all\n")
    assert run(copy).returncode != 0
