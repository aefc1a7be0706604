"""The library without its training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()), [n for n in e.queries() if n.startswith('op')])"


def test_imports_without_it(tmp_path):
    shutil.copytree(HERE / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    for left_over in (None, tmp_path / "quillgraph/llm/__pycache__"):
        if left_over:
            left_over.mkdir(parents=True)
        got = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert got.returncode == 0, got.stderr
        same, count, ops = got.stdout.strip().splitlines()[-1].split(" ", 2)
        assert same == "True" and int(count) > 50 and ops == "[]"


def test_broken_imports_show(tmp_path):
    shutil.copytree(HERE / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    (tmp_path / "quillgraph/llm").mkdir()
    (tmp_path / "quillgraph/llm/__init__.py").write_text("import no_such_module\n")
    (tmp_path / "corpus_pipeline.py").write_text("import quillgraph.llm\n")
    got = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode != 0 and "no_such_module" in got.stderr
