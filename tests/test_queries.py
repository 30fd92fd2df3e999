"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from wirelake.plans import queries_io  # noqa: F401  registers its queries
from wirelake.plans.queries import ORACLE, QUERIES


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.9g}"
    return str(v)


def table(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(cell(r[i]) for i in at) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert table([tuple(r) for r in df.collect()], df.columns, order) == table(want.fetchall(), want.columns, order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_source_filters_reach_the_scan(spark, tmp_path, sf):
    from pyspark.sql import functions as F

    from wirelake.plans import tables, viewer
    from wirelake.plans.harness import gold

    tables.write_gold(gold(spark, sf), str(tmp_path / "gold"))
    read = spark.read.parquet(str(tmp_path / "gold"))
    plan = read.where(viewer.any_key([("CAN", 1, "click")])).select("timestamp_s", "signal_value")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "signal_source" in plan and "EqualTo(signal_name,click)" in plan and "signal_str" not in plan.split("ReadSchema")[1]
    assert read.where(F.col("signal_source") == "ETH").count() == gold(spark, sf).where("signal_source = 'ETH'").count()


def test_library_stands_without_the_training_operators():
    import ast
    from pathlib import Path

    for path in Path(__file__).resolve().parent.parent.glob("wirelake/**/*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path
