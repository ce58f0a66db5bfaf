"""The driver's contract: names, SQL only for queries that exist, and an optional subpackage that nothing else needs."""

from __future__ import annotations

import importlib.util
import pathlib
import re

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "auc_quality" in queries
    numbers = {int(m[1]) for n in queries if (m := re.match(r"op(\d+)_", n))}
    assert numbers in (set(), set(range(1, 11)))
    there = importlib.util.find_spec("corpusmill.llm") is not None and importlib.util.find_spec("corpusmill.llm.queries") is not None
    assert bool(numbers) == there and ("pipeline" in queries) == (there and (ROOT / "corpus_pipeline.py").exists())


def test_the_optional_subpackage_is_optional():
    for path in (ROOT / "corpusmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
