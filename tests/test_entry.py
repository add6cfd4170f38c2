"""The library without its text subpackage: what is registered still loads and runs."""

import json
import os
import shutil
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import json, __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""


def _registered(home):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", PROBE], cwd=home, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return json.loads(said.stdout.splitlines()[-1])


def _copy(tmp_path, *without):
    home = tmp_path / "copy"
    shutil.copytree(HOME, home, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in without:
        path = home / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    return home


def test_core_stays_without_the_text_subpackage(tmp_path):
    from quarry.plans import catalog

    for without in (["quarry/llm", "tests/llm", "corpus_pipeline.py"], ["quarry/llm", "tests/llm"]):
        home = _copy(tmp_path / str(len(without)), *without)
        assert _registered(home) == [sorted(catalog.queries()), sorted(catalog.oracle_sql())]


def test_nothing_else_imports_the_text_subpackage():
    for folder, _, names in os.walk(os.path.join(HOME, "quarry")):
        if os.path.join("quarry", "llm") in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "quarry.llm" not in f.read(), name
