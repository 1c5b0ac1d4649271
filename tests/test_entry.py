"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry.__doc__


def test_imports_without_the_corpus_operators(tmp_path):
    """The rest works when the corpus folders and the pipeline are gone."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and ".git" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pareto_arrivals' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
