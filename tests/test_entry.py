"""The entry points without their optional part, and workers without the package on their path."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def without_llm(tmp_path):
    """A copy of the library in which the corpus operators are missing."""
    keep = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.pyc")
    shutil.copytree(ROOT / "pulsewarden", tmp_path / "lib" / "pulsewarden", ignore=keep)
    for name in ("__spark_entry__.py", "check_oracle.py"):
        shutil.copy(ROOT / name, tmp_path / "lib" / name)
    return tmp_path / "lib"


def run(code, cwd):
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_corpus_operators_are_optional(without_llm):
    out = run("import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))", without_llm)
    assert int(out[0]) > 100 and out[1] == "False"


def test_nothing_else_imports_the_corpus_operators():
    for f in [*(ROOT / "pulsewarden").rglob("*.py"), ROOT / "bench.py", ROOT / "check_oracle.py"]:
        if "llm" not in f.relative_to(ROOT).parts:
            assert "pulsewarden.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text()


def test_workers_get_the_package(tmp_path):
    """A Python worker function runs from a folder where the package can't be found."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pulsewarden.session import get_spark
from pulsewarden.operators.detectors.iforest import IsolationForest
spark = get_spark("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r}}})
f = IsolationForest(["id"], "id", n_trees=3, max_samples=8)
f.train(spark.range(100))
print("rows", f.score(spark.range(100)).count(), f.score(spark.range(100)).agg({{"raw_score": "max"}}).first()[0] > -1)
"""
    assert run(code, tmp_path)[-3:] == ["rows", "100", "True"]


def test_scratch_goes_with_the_application(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pulsewarden.session import drop, get_spark, materialize
spark = get_spark("scratch", "local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path / "s")!r}}})
kept, gone = materialize(spark.range(5)), materialize(spark.range(6))
drop(gone)
print(kept.count())
"""
    run(code, tmp_path)
    assert not list((tmp_path / "s").rglob("*.parquet"))
