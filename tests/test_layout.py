"""The library without the subpackage of training-data operators."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "auditlake")):
        if os.path.basename(folder) != "llm":
            for f in (f for f in files if f.endswith(".py")):
                assert not re.search(r"^\s*(from|import)\b.*\bllm\b", open(os.path.join(folder, f)).read(), re.M), f


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "auditlake"), tmp_path / "auditlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not any(k.startswith('op1_') for k in e.queries())"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
