"""The driver's contract: every oracle has its query, names agree, and the llm part may be gone."""

import importlib
import sys

import __spark_entry__


def test_oracles_have_queries():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def gone(name, *a):
        if name == "tidemark.llm":
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert "p5_found" in __spark_entry__.queries() and not any(k.startswith("p3_") for k in __spark_entry__.queries())
