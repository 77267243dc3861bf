"""A cross-section of registered queries equals its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows

SF = "/root/testdata/sf0.001"
NAMES = [
    "views", "atoms", "path_tier_join", "rule_match", "analyze_commands", "answers_evaluate", "adjudicate", "brier",
    "holdout_split", "render_state", "replay_decisions", "threshold_sweep", "parity_diff", "stream_score", "stream_errors",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, result.fetchall())
