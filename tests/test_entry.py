import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path):
    """A copy without tapeloom/llm, tests/llm and corpus_pipeline.py imports and keeps the other queries."""
    import shutil

    for name in ("tapeloom", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1_') or n == 'pipeline' for n in q), len(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
