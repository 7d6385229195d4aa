"""The entry module without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; names = e.queries(); print(len(names), 'pipeline' in names, any(n.startswith('op1_') for n in names), set(e.oracle_sql()) <= set(names))"


@pytest.mark.parametrize("gone", ["llm", "pipeline", "both", "module"])
def test_imports_without(tmp_path, gone):
    shutil.copytree(f"{ROOT}/trialbook", tmp_path / "trialbook", ignore=shutil.ignore_patterns("__pycache__", "llm" if gone in ("llm", "both") else "-"))
    for name in ["__spark_entry__.py", *([] if gone in ("pipeline", "both") else ["corpus_pipeline.py"])]:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    if gone == "module":  # a third-party module of the operators is missing
        (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    found = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, check=True)
    count, pipeline, corpus, whole = found.stdout.split()
    assert int(count) >= 156 and whole == "True" and pipeline == "False"
    if gone != "pipeline":
        assert corpus == "False"
