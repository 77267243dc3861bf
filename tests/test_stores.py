"""Stored results compared through their checksums: differences, repeats, nulls, and what is read."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shellgauge.plans import stores
from shellgauge.session import scratch

SCHEMA = "k string, a string, b int, tags array<string>, leaf string"
FIELDS = ["a", "b", "tags"]
ROWS = [(f"c{i}", f"v{i % 7}", i, ["x"] * (i % 3), "clash") for i in range(400)]


def store(spark, rows, leaves=256):
    made = stores.ResultStore(spark, scratch(spark, "store"), leaves)
    df = spark.createDataFrame(rows, SCHEMA)
    made.write(df, "k", FIELDS)
    return made, stores.rows_schema(df, "k", FIELDS)


def diffs(spark, ours, golden):
    a, schema = store(spark, ours)
    b, _ = store(spark, golden)
    return sorted((r["key"] or "", r["diff"]) for r in stores.compare(a, b, schema, FIELDS).collect())


def brute(ours, golden):
    """By key: distinct rows are few here, so only their counts and fields are looked at."""
    out = []
    a, b = {}, {}
    for rows, side in ((ours, a), (golden, b)):
        for k, *f, _ in rows:
            side.setdefault(k, Counter())[repr(f)] += 1
    fields = {(k, repr(f)): f for rows in (ours, golden) for k, *f, _ in rows}
    for k in {*a, *b}:
        x, y = a.get(k, Counter()), b.get(k, Counter())
        if x == y:
            continue
        if not x or not y:
            out += [(k or "", "missing" if not x else "extra")] * len(x or y)
        elif len(x) == len(y) == 1:
            (p, n), (q, m) = *x.items(), *y.items()
            names = [c for c, u, v in zip(FIELDS, fields[k, p], fields[k, q]) if u != v]
            out.append((k or "", ",".join(names) or "times"))
    return sorted(out)


def test_planted_differences(spark):
    golden = [r for r in ROWS if r[0] not in ("c3", "c4")] + [("new", "v", 1, [], ""), (None, "v", 1, None, "")]
    golden[10] = (golden[10][0], "other", -1, golden[10][3], "")
    golden[20] = (*golden[20][:3], None, "")
    golden.append(golden[30])
    ours = [*ROWS, (None, "v", 2, None, "")]
    got = diffs(spark, ours, golden)
    assert got == brute(ours, golden)
    assert Counter(d for _, d in got) == {"extra": 2, "missing": 1, "a,b": 1, "tags": 1, "b": 1, "times": 1}


def test_nulls_that_change_places(spark):
    """A null and a value that swap fields are a difference, although a struct's hash would not tell."""
    schema = "k string, a string, b string"
    one, other = (spark.createDataFrame([("k", *v)], schema) for v in ((None, "x"), ("x", None)))
    made = []
    for df in (one, other):
        made.append(stores.ResultStore(spark, scratch(spark, "store"), 64))
        made[-1].write(df, "k", ["a", "b"])
    got = stores.compare(*made, stores.rows_schema(one, "k", ["a", "b"]), ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("k", "a,b")]


def test_rows_of_one_key(spark):
    """A hot key: equal rows are counted, and their order does not matter."""
    hot = [("hot", "v", 1, [], "")] * 500 + [("hot", "v", 2, [], "")] * 3
    assert diffs(spark, [*ROWS, *hot], [*reversed(hot), *ROWS]) == []
    assert [d for _, d in diffs(spark, [*ROWS, *hot], [*ROWS, *hot[:-1]])] == ["times"]
    assert [d for _, d in diffs(spark, [*ROWS, *hot], [*ROWS, *hot[:500]])] in (["extra"], ["b", "extra"])


def test_empty(spark):
    assert diffs(spark, [], []) == []
    assert diffs(spark, ROWS[:2], []) == [("c0", "extra"), ("c1", "extra")]
    assert diffs(spark, [], ROWS[:1]) == [("c0", "missing")]


def test_equal_stores_read_no_rows(spark):
    """The plan of equal stores selects no directory of rows; one changed row selects one on each side."""
    a, schema = store(spark, ROWS)
    same, _ = store(spark, list(reversed(ROWS)))
    one, _ = store(spark, [*ROWS[:-1], (*ROWS[-1][:2], -5, [], "")])
    assert a.top_sums().count() <= stores.TOPS and stores.compared_rows(a) == len(ROWS)

    def tops(golden):
        return [r["top"] for r in stores._unequal(a.top_sums(), golden.top_sums(), "top").collect()]

    assert tops(same) == [] and stores.compare(a, same, schema, FIELDS).count() == 0
    assert len(tops(one)) == 1
    leaf = a.rows(schema).filter(F.col("key") == ROWS[-1][0]).first()
    assert tops(one) == [leaf["top"]]
    plan = stores.compare(a, one, schema, FIELDS)._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [top") + plan.count("PartitionFilters: [isnotnull(top") >= 2
    found = stores.compare(a, one, schema, FIELDS).collect()
    assert [tuple(r) for r in found] == [(ROWS[-1][0], "b" if not ROWS[-1][3] else "b,tags")]


def test_different_numbers_of_leaves(spark):
    with pytest.raises(ValueError, match="leaves"):
        stores.compare(store(spark, ROWS)[0], store(spark, ROWS, 64)[0], None, FIELDS)
