"""Reports over the labelled log equal their SQL; no later definition hides an earlier one."""

import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import shellgauge
from tools.check_oracle import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tier_purity", "detection_metrics", "wilson_mcnemar", "auc_tar", "tier_ablation"])
def test_report_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


def test_no_function_is_defined_twice():
    for path in Path(shellgauge.__file__).parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path
