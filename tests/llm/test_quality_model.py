"""Held-out accuracy, calibration and edge rows of the quality score."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shellgauge.llm import quality_model as q

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.score(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    assert auc > 0.97 and (good >= q.ACCEPT).mean() > 0.95 and (bad < q.ACCEPT).mean() > 0.9
    # labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in q.score(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in rows)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=2, max_size=20).filter(lambda x: any(n for n, _ in x)))
def test_isotonic(cells):
    counts = np.array([n for n, _ in cells], dtype=float)
    sums = np.array([min(n, y) for n, y in cells], dtype=float)
    fitted = q.isotonic(counts, sums)
    assert (np.diff(fitted) >= -1e-12).all()
    assert abs((fitted * counts).sum() - sums.sum()) < 1e-6


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x" * 50_000), (3, "x" * 50_000), (4, " \n"), (5, "é ñ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("fold", F.lit("q"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = q.score(docs, none).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (5, None)], "doc_id long, quality int")
    assert {r["score"] for r in q.score(docs, one).collect()} == {1.0}
    assert q.score(docs.limit(0), one).collect() == []
    zeros = [q.measure(t) for t in ("", " \n")]
    assert zeros == [[0.0] * len(q.STATISTICS)] * 2
