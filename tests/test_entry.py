import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data subpackage, its tests and perhaps the pipeline, the entry has all its other queries."""
    for gone in (("tessella/llm", "tests/llm"), ("tessella/llm", "tests/llm", "corpus_pipeline.py")):
        at = tmp_path / str(len(gone))
        shutil.copytree(ROOT, at, ignore=lambda d, names: {n for n in names if n.startswith(".") or n == "__pycache__" or os.path.relpath(os.path.join(d, n), ROOT) in gone})
        assert not (at / "tessella/llm").exists()
        code = "import __spark_entry__ as E; q = E.queries(); assert len(q) > 70 and set(E.oracle_sql()) <= set(q); assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={**os.environ, "PYTHONPATH": str(at)})
