import builtins
import importlib
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing, raises", [("corpus_pipeline", False), ("shelfcast.llm.queries", False), ("some_library", True)])
def test_only_absent_corpus_operators_are_forgiven(monkeypatch, missing, raises):
    real = builtins.__import__

    def fails(name, *args, **kwargs):
        if name in ("corpus_pipeline", "shelfcast.llm.queries"):
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return real(name, *args, **kwargs)

    import __spark_entry__ as entry
    monkeypatch.setattr(builtins, "__import__", fails)
    try:
        if raises:
            with pytest.raises(ModuleNotFoundError):
                importlib.reload(entry)
        else:
            assert not any(name.startswith("op1") for name in importlib.reload(entry).queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_basket_rules_from_another_folder(tmp_path):
    """Python workers find the package though neither their folder nor their path has it."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("rules", entry.queries()["basket_rules"](spark, "/root/testdata/sf0.001").count())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=600,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rules" in done.stdout, done.stderr[-3000:]
