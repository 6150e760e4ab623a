"""The driver's contract, with and without the llm folders."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_llm(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("tarn", ".git", "tests", "corpus_pipeline.py"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tarn").mkdir()
    for p in (ROOT / "tarn").iterdir():
        if p.name != "llm":
            (tmp_path / "tarn" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
