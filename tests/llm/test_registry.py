"""Queries against their SQL, and the guard of the entry module."""

import importlib
import sys

import pytest

from ledgerline.llm import registry
from tests.conftest import SF001
from tools.check_oracle import digest


def test_one_query_per_operator():
    assert [int(n.split("_")[0][2:]) for n in registry.queries()] == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, duck_sf001, name):
    sp = registry.queries()[name](spark, SF001).toPandas()
    dk = duck_sf001.sql(registry.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns) and len(sp) > 0
    assert digest(sp) == digest(dk)


def test_entry_imports_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("ledgerline.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("ledgerline.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    finder = Gone()
    monkeypatch.setattr(sys, "meta_path", [finder, *sys.meta_path])
    try:
        bare = importlib.reload(entry)
        assert "pipeline" not in bare.queries() and not any(n.startswith("op1") for n in bare.queries()) and bare.queries()
    finally:
        sys.meta_path.remove(finder)
        importlib.reload(entry)
    assert "pipeline" in entry.queries()
