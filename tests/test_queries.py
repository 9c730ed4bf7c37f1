"""Every query of the core against its SQL; those without SQL must run."""

import ast
from pathlib import Path

import pytest

from patientflow.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, compare):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_core_does_not_import_llm():
    for f in (ROOT / "patientflow").rglob("*.py"):
        if "llm" in f.relative_to(ROOT / "patientflow").parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), f


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
