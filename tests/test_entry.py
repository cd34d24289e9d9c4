"""The driver's entry points, with and without the optional queries."""

from __future__ import annotations

import builtins
import importlib

import __spark_entry__ as driver
from pulltally.samples.queries import QUERIES


def test_queries_and_sql_fit():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.queries())


def test_imports_without_the_optional_folder(monkeypatch):
    plain = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("pulltally.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return plain(name, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(builtins, "__import__", blocked)
        alone = importlib.reload(driver)
        assert set(alone.queries()) == set(QUERIES) == set(alone.oracle_sql())
    importlib.reload(driver)


def test_flagship(spark):
    assert driver.entry(spark).limit(1).count() == 1
