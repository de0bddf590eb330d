"""The entry where the text operators can't be imported."""

import importlib.util
import sys
from pathlib import Path

import pytest

from cubeloom import catalog, registry  # noqa: F401


def test_the_array_queries_stay_without_the_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.spec_from_file_location("entry_alone", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    with pytest.warns(UserWarning, match="corpus_pipeline"):
        spec.loader.exec_module(entry)
    assert entry.queries().keys() == registry.queries().keys() and entry.oracle_sql() == registry.oracle_sql()
