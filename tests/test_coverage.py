"""COVERAGE.md against the code: every function that it names is reached by a query of its row, or by a unit test where the row says so."""

import ast
import re
from collections import defaultdict
from pathlib import Path

import pytest

from patientflow.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]


def rows():
    out = []
    for line in (ROOT / "COVERAGE.md").read_text().splitlines():
        cells = [c.strip() for c in line.strip("|").split("|")]
        if line.startswith("| ") and len(cells) == 3 and cells[0] not in ("ID", "---"):
            out.append((cells[0], [x.split(".")[-1] for x in re.findall(r"`([\w.]+)`", cells[1])], re.findall(r"`(\w+)`(†?)", cells[2]), cells[2]))
    return out


def graph():
    """Names that each function, method or class of the core uses, by its simple name; and the function of each registered query."""
    uses, of = defaultdict(set), {}
    for f in (ROOT / "patientflow").rglob("*.py"):
        if "llm" in f.parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                uses[node.name] |= {x.id for x in ast.walk(node) if isinstance(x, ast.Name)} | {x.attr for x in ast.walk(node) if isinstance(x, ast.Attribute)}
                for d in node.decorator_list:
                    if isinstance(d, ast.Call) and getattr(d.func, "attr", "") == "query":
                        of[d.args[0].value] = node.name
    for q in QUERIES:  # registered in a loop over the tables
        if q.startswith("cdm_") and q not in of:
            of[q] = q.removeprefix("cdm_")
            uses[of[q]] |= {"cdm_tables"}
    return uses, of


def reached(uses, start):
    seen, todo = set(), [start]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += uses.get(n, ())
    return seen


def test_every_function_is_reached():
    uses, of = graph()
    tests = "\n".join(f.read_text() for f in (ROOT / "tests").glob("*.py"))
    wrong = []
    for ids, functions, queries, text in rows():
        names = [q for q, _ in queries if q in QUERIES]
        wrong += [(ids, q, "no query") for q, _ in queries if q not in QUERIES]
        wrong += [(ids, q, "mark of SQL") for q, mark in queries if q in QUERIES and bool(mark) == (q in SQL)]
        found = set().union(*[reached(uses, of[q]) for q in names]) if names else set()
        for f in functions:
            if f not in uses:
                wrong.append((ids, f, "unknown"))
            elif "unit test" in text:
                if not re.search(rf"\b{f}\b", tests):
                    wrong.append((ids, f, "no test"))
            elif "every query" not in text and f not in found:
                wrong.append((ids, f, "not reached"))
    assert not wrong


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_is_listed(name):
    assert f"`{name}`" in (ROOT / "COVERAGE.md").read_text() or name in ("p2_found", "p2_report", "p6_found", "p6_periods")
