"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') for n in q), set(s) <= set(q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [["foldlake/llm", "corpus_pipeline.py"], ["foldlake/llm"], ["corpus_pipeline.py"], ["foldlake/llm/*.py"]])
def test_entry_without_the_llm_folders(tmp_path, gone):
    """Each way of taking them away leaves the rest whole; no module of the rest imports them."""
    place = tmp_path / "repo"
    shutil.copytree(ROOT, place, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm" if "foldlake/llm" in gone else "-"))
    for name in gone:
        for path in place.glob(name):
            path.unlink() if path.is_file() else shutil.rmtree(path)
    run = subprocess.run([sys.executable, "-c", CODE], cwd=place, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(place)})
    n, ops, known, pipeline = run.stdout.split() or [run.stderr]
    has_llm = gone == ["corpus_pipeline.py"] and os.path.isdir(f"{ROOT}/foldlake/llm")
    assert int(n) > 80 and known == "True" and (int(ops) > 0) == has_llm and pipeline == "False"
