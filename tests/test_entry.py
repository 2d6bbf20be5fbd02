"""The driver's contract: every query of the library against its SQL, and its independence of the llm folder."""

import ast
import math
from pathlib import Path

import duckdb
import pytest

from folioframe.plans import slate

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(slate.ORACLE_SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got = slate.QUERIES[name](spark, SF)
    want = oracle.sql(slate.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine, theirs = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6)) or str(x) == str(y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(slate.QUERIES) - set(slate.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    frame = slate.QUERIES[name](spark, SF)
    assert frame.columns and (not frame.isEmpty() or name in ("concept_spans", "distinct_concepts"))


def test_nothing_else_imports_llm():
    for path in (ROOT / "folioframe").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "folioframe").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_and_oracles(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "title", "hits", "snippet"]
