"""The driver's contract, with and without the optional parts."""

import importlib
import sys

import __spark_entry__ as entry
from terraspan.plans import all as library


def test_queries_and_their_sql():
    names = set(entry.queries())
    assert set(library.QUERIES) <= names and set(entry.oracle_sql()) <= names


def test_without_the_optional_parts(monkeypatch):
    for name in ("terraspan.llm", "terraspan.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(library.QUERIES) and set(alone.oracle_sql()) == set(library.SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["well", "zone", "run", "x", "y", "dfrac", "n"]
