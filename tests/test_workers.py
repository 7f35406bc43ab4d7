import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_workers_need_no_copy_of_the_package(tmp_path, sf):
    """The package is on the driver's path only; workers start in another folder."""
    script = tmp_path / "run.py"
    script.write_text(
        f"""import sys
sys.path.insert(0, {str(REPO)!r})
import importlib
import __spark_entry__ as entry
from skein.session import get_session
spark = get_session("workers", 4, spark__sql__shuffle__partitions="4")
for module in entry.CORE:
    for name, f in importlib.import_module(module).QUERIES.items():
        if name in ("bm25_topk", "vector_topk", "gold_mapping", "seed_ilike", "alias_linking", "chunk_documents"):
            assert f(spark, {sf!r}).count() > 0, name
"""
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]
