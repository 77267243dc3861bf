"""Counts against plain loops; learned lists; verdicts."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from shellgauge.llm import quality_rules as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "", None, " \t\n", "one", "a b c d e a b c d e", "a a a a a a", "x\nx\n\n \nx\ty\nx", "# * $ % & | < >", "é é ñ x\x1cy z",
    "a b c d e f " * 400, "word " * 5000, "p q r s t u p q r s t", "l\r\nl\r\nl",
]


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[4]), (None, TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("s", F.lit(0))
    got = sorted(tuple(map(str, r)) for r in q.judge(df, []).collect())
    want = []
    for key, text in rows:
        counts = plain(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want.append(tuple(map(str, (key, *counts, failed, not failed))))
    assert got == sorted(want)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in q.judge(docs, []).collect():
        assert tuple(r[c] for c in q.BASE) == plain(texts[r["doc_id"]])


@pytest.fixture(scope="module")
def tables(spark):
    prose = "the quick brown fox number {} jumps over a lazy dog while some {} others sleep near river {} bank today"
    good = [(i, prose.format(i, i * 7, i * 13), 1) for i in range(120)]
    bad = [(1000 + i, " ".join(f"w{j + i * 31}$" for j in range(20 + i % 5)), 0) for i in range(60)]
    loud = [(2000 + i, prose.format(i, i * 3, i * 11).upper(), 0) for i in range(60)]
    rows = good + bad + loud
    return (
        spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"),
        spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 0), (5, None)], "doc_id long, quality int"),
    )


def test_learns_ordered_rules(spark, tables):
    docs, labels = tables
    rules = q.learn(docs, labels)
    assert 1 <= len(rules) <= q.MAX_RULES and all(1 <= len(r) <= q.MAX_CONDITIONS for r in rules)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    for r in q.judge(docs, rules).collect():
        assert r["kept"] == (truth[r["doc_id"]] == 1 and not r["base_failed"]), r
    kept = q.keep_good(docs.withColumn("__doc", F.lit(1)).withColumn("s", F.lit("z")), rules)
    assert kept.columns == ["doc_id", "text", "__doc", "s"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in q.judge(docs, rules).collect() if r["kept"]}


def test_no_labels_and_empty(spark, tables):
    docs, labels = tables
    assert q.learn(docs, labels.limit(0)) == []
    assert q.learn(docs.limit(0), labels) == []
    assert q.judge(docs.limit(0), []).collect() == []


def test_native_plan(spark, tables):
    docs, labels = tables
    plan = q.judge(docs, q.learn(docs, labels))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(q, "MAX_LABELLED", 50)
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    assert 20 <= q.labelled_sample(labels).count() <= 100
