"""The driver's entry points, and that nothing but the entry knows the llm subpackage."""

from __future__ import annotations

import importlib
import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_without_the_llm_folder(monkeypatch):
    """The other queries stay when the subpackage and the pipeline are gone."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tidemark.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith("tidemark.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    from tidemark.plans import QUERIES

    assert e.queries().keys() == QUERIES.keys()


def test_library_does_not_import_llm():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s+tidemark\.llm", p.read_text(), re.M), p
