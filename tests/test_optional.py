import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and '_' in n and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"


def copied(tmp_path):
    shutil.copytree(os.path.join(ROOT, "amplispark"), tmp_path / "amplispark", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    return tmp_path


def shown(at):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SHOW], cwd=at, env=env, capture_output=True, text=True, timeout=300)


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_loads_without_the_optional_subpackage(tmp_path, pipeline):
    at = copied(tmp_path)
    if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), at)
    out = shown(at)
    assert out.returncode == 0, out.stderr
    queries, oracles, optional = out.stdout.split()
    assert int(queries) > 100 and int(oracles) > 100 and optional == "False"


def test_other_missing_modules_are_raised(tmp_path):
    at = copied(tmp_path)
    (at / "corpus_pipeline.py").write_text("import no_such_module_here")
    out = shown(at)
    assert out.returncode != 0 and "no_such_module_here" in out.stderr
