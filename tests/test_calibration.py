"""Fits recover known parameters; splits and metrics behave."""

import math

import pytest
from pyspark.sql import functions as F

from shellgauge.operators import calibration as cal

PAIRS = "item_id int, axis string, type string, p array<double>, q array<double>"


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def temper(p, t):
    e = [x ** (1 / t) for x in p]
    return [x / sum(e) for x in e]


def data(n=120):
    out = []
    for i in range(n):
        p = (i % 97 + 1) / 99
        out.append((i, "n1", "noul", [p], [sigmoid(1.5 * math.log(p / (1 - p)) - 0.7)]))
        out.append((i, "n2", "noul", [p], [sigmoid(1.7 * math.log(p / (1 - p)) - 0.4)]))
        w = [(i * k) % 17 + 1 for k in (1, 3, 5)]
        v = [x / sum(w) for x in w]
        out.append((i, "c1", "choice", v, temper(v, 0.6)))
    return out


def test_fits_recover_parameters(spark):
    pairs = spark.createDataFrame(data(), PAIRS)
    platt = {p["axis"]: p for p in cal.fit_platt(pairs)}
    assert platt["n1"]["a"] == pytest.approx(1.5, abs=1e-3) and platt["n1"]["b"] == pytest.approx(-0.7, abs=1e-3)
    assert platt["n2"]["a"] == pytest.approx(1.7, abs=1e-3) and platt["n2"]["b"] == pytest.approx(-0.4, abs=1e-3)
    assert cal.fit_temperature(pairs)[0]["t"] == pytest.approx(0.6, abs=1e-3)


def test_report(spark):
    items = spark.range(120).select(F.col("id").cast("int").alias("item_id"))
    split = cal.holdout_split(items)
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 90, "test": 30}
    assert split.orderBy("item_id").collect() == cal.holdout_split(items.repartition(7)).orderBy("item_id").collect()
    few = spark.createDataFrame([(i, "few", "noul", [0.5], [0.5]) for i in range(8)], PAIRS)
    pairs = spark.createDataFrame(data(), PAIRS).unionByName(few).join(split, "item_id")
    params, report = cal.fit_report(pairs)
    rows = {r.axis: r for r in report.collect()}
    assert {p["axis"] for p in params} == {"n1", "n2", "c1"}
    assert rows["n1"].n_train == 90 and rows["n1"].n_test == 30
    assert rows["n1"].brier_after * 10 < rows["n1"].brier_before
    assert "fitting pairs (< 10)" in rows["few"].skipped and rows["few"].a is None


def test_metrics(spark):
    pairs = spark.createDataFrame(
        [(0, "a", "noul", [0.2], [0.0]), (1, "a", "noul", [0.9], [1.0]), (2, "a", "noul", [1.0], [1.0])], PAIRS)
    assert cal.brier(pairs).head().brier == pytest.approx((0.04 + 0.01) / 3)
    assert cal.ece(pairs).head().ece == pytest.approx((0.2 + 0.1) / 3)


def test_validation(spark):
    axes = spark.createDataFrame([("a", "noul"), ("b", "choice")], "id string, primitive string")
    params = spark.createDataFrame(
        [("a", "noul", "platt", 1.0, 0.0, None), ("a", "noul", "temperature", None, None, 1.0),
         ("b", "choice", "temperature", None, None, 0.0), ("z", "noul", "platt", 1.0, 0.0, None),
         ("a", "noul", "platt", float("nan"), 0.0, None)],
        "axis string, type string, method string, a double, b double, t double")
    got = sorted(r.problem for r in cal.validate_params(params, axes).collect())
    assert got == ["a and b must be finite", "axis is not in the rubric", "method does not apply",
                   "t must be finite and > 0"]
