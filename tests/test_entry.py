"""The driver's entry points without the training-data subpackage, or without what it needs."""

import sys

import __spark_entry__
from revlens.plans import registry


def test_other_queries_stand_alone(monkeypatch):
    for gone in ("corpus_pipeline", "revlens.llm.catalog", "revlens.llm"):
        monkeypatch.setitem(sys.modules, gone, None)  # importing it raises ImportError
    assert list(__spark_entry__.queries()) == list(registry.CATALOG)
    assert set(__spark_entry__.oracle_sql()) <= set(registry.CATALOG)


def test_a_missing_dependency_of_the_subpackage_takes_only_its_queries(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("revlens.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    monkeypatch.setitem(sys.modules, "tokenizers", None)
    assert list(__spark_entry__.queries()) == list(registry.CATALOG)
