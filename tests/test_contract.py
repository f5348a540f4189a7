"""The driver's contract: names, columns, and SQL of the queries."""

import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ocellus.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_names():
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["qwk"] and entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["confusion", "join_audit", "subsample_balanced", "qc_cohort_flags", "roc_points", "patch_moments"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = c.sql(catalogue.ORACLES[name]).df()[got.columns]
    rows = lambda d: sorted(tuple(round(float(x), 6) if isinstance(x, (int, float)) else str(x) for x in r) for r in d.itertuples(index=False))
    assert rows(got) == rows(want)


def test_the_corpus_part_can_be_left_out():
    for p in (ROOT / "ocellus").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), p
