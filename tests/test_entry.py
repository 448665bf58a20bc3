"""The entry works without the corpus operators, which may be deleted."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_without_the_operators(tmp_path):
    shutil.copytree(REPO / "syndilake", tmp_path / "syndilake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'quality_by_format' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(p for p in sys.path if 'site-packages' in p)}"})


def test_every_module_without_the_operators(tmp_path):
    """The library's other modules neither import the operators nor need them."""
    shutil.copytree(REPO / "syndilake", tmp_path / "syndilake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = [".".join(p.relative_to(tmp_path).with_suffix("").parts) for p in sorted((tmp_path / "syndilake").rglob("*.py"))]
    code = "import importlib\n" + "\n".join(f"importlib.import_module({n!r})" for n in names if not n.endswith("__init__"))
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(p for p in sys.path if 'site-packages' in p)}"})


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
