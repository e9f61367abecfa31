"""The entry module with and without the optional text operators."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _names(*hidden: str) -> list[str]:
    code = "import sys\n" + "".join(f"sys.modules[{h!r}] = None\n" for h in hidden) + "import __spark_entry__ as e\nprint(*e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_imports_without_the_text_operators():
    bare = _names("cohortia.llm", "corpus_pipeline")
    assert len(bare) > 200 and not [n for n in bare if n == "pipeline" or n.startswith("op1")]
    assert set(bare) <= set(_names())


def test_oracles_belong_to_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
