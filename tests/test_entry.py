"""The entry points and the separation of the optional part."""

import ast
from pathlib import Path

import __spark_entry__
from loomline.plans import catalogue, extensions  # noqa: F401

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    row = __spark_entry__.entry(spark).filter("o_orderkey = 1").first() or __spark_entry__.entry(spark).first()
    assert row["total_eur"].startswith("€") and row["total_gbp"].startswith("£") and row["total_usd"].startswith("$")


def test_registered():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(catalogue.ORACLE_SQL) == set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_optional_part():
    for p in (ROOT / "loomline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "loomline").parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), p


def test_plans(spark):
    """Filters and columns reach the scan, and nothing runs in Python."""
    sf = "/root/testdata/sf0.001"
    plan = lambda q: catalogue.QUERIES[q](spark, sf)._jdf.queryExecution().toString()
    count = plan("q_filter_count")
    assert "EqualTo(o_orderstatus,P)" in count and "ReadSchema: struct<o_orderstatus:string>" in count
    assert not any("Python" in plan(q) or "Arrow" in plan(q) for q in catalogue.QUERIES)
