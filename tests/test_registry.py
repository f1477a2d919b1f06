import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; o = e.oracle_sql(); q = e.queries(); assert set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
