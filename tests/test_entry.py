"""The entry file with the whole tree, and with a copy that lacks the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert found and set(sql) <= set(found)
print(len(found), sum(n.startswith("op") and n[2].isdigit() for n in found), "pipeline" in found)
"""


def run(root):
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=root, capture_output=True, text=True, check=True)
    return done.stdout.split()


def copied(tmp_path, *left_out):
    gone = {ROOT / x for x in left_out} | {ROOT / ".git"}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: {n for n in names if Path(d) / n in gone})
    return tmp_path / "copy"


def test_without_the_llm_folders(tmp_path):
    n, operators, pipeline = run(copied(tmp_path, "textlode/llm", "tests/llm"))
    assert int(n) > 100 and operators == "0" and pipeline == "False"


def test_without_the_llm_folders_and_the_pipeline(tmp_path):
    n, operators, pipeline = run(copied(tmp_path, "textlode/llm", "tests/llm", "corpus_pipeline.py"))
    assert int(n) > 100 and operators == "0" and pipeline == "False"
