"""Classes against brute force over all pairs; crowds; keeping one."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellgauge.llm import near_dup as q

SF = "/root/testdata/sf0.01"


def shingles(text):
    """Windows labelled with their occurrence, as the operator sees them."""
    w = q.WORD.findall(text or "")
    seen, out = Counter(), set()
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i : i + 5])
        out.add((s, seen[s]))
        seen[s] += 1
    return out


def brute(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    words = {k: q.WORD.findall(t or "") for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            union = len(sets[a] | sets[b])
            if words[a] == words[b] or (min(len(sets[a]), len(sets[b])) > 3 and union and len(sets[a] & sets[b]) >= 0.8 * union):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in texts}


def prose(dice, n):
    return [f"w{dice.randint(0, 5000)}" for _ in range(n)]


@pytest.mark.parametrize("direct", [1, 12])
def test_documents(spark, monkeypatch, direct):
    monkeypatch.setattr(q, "DIRECT", direct)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in q.near_duplicates(docs).collect()}
    assert got == brute({r["doc_id"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("direct", [1, 12])
def test_crowd_of_copies(spark, monkeypatch, direct):
    """One text copied 150 times with none to many edits, among short and unrelated texts."""
    monkeypatch.setattr(q, "DIRECT", direct)
    dice = random.Random(2)
    base, texts = prose(dice, 150), {}
    for i in range(150):
        own = base[:]
        for _ in range(dice.randint(0, 12)):
            own[dice.randrange(len(own))] = f"x{dice.randint(0, 10**6)}"
        texts[i] = " ".join(own)
    for i in range(150, 220):
        texts[i] = " ".join(prose(dice, dice.randint(1, 60)))
    for i in range(220, 260):
        short = texts[150 + (i - 220)].split()
        texts[i] = "  ".join(short) if i % 2 else " ".join([*short, "more"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in q.near_duplicates(df).collect()} == brute(texts)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (4, "a  b c"), (4, "a  b c"), (None, "lonely words here"), (5, "z " * 20_000), (6, "z " * 20_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit(1)).withColumn("node", F.lit("x"))
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in q.near_duplicates(df).collect())
    assert got == sorted([("1", "1"), ("2", "1"), ("3", "1"), ("None", "4"), ("4", "4"), ("4", "4"), ("None", "None"), ("5", "5"), ("6", "5")])
    kept = q.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])[:20]) for r in kept.collect()) == sorted(
        [("1", "None"), ("4", "a  b c"), ("None", "lonely words here"), ("5", ("z " * 10))]
    )
    assert q.near_duplicates(df.limit(0)).collect() == [] and q.keep_one(df.limit(0)).collect() == []


def test_order_matters():
    a = np.arange(40, dtype=np.uint32)
    swapped = np.concatenate([a[20:], a[:20]])
    assert q.aligned(q.windows(a), q.windows(a)) == 1.0
    assert q.aligned(q.windows(a), q.windows(swapped)) < 0.5


def test_keep_one_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(q, "MAX_DROPPED", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    classes = {r["doc_id"]: r["class_id"] for r in q.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in q.keep_one(docs).collect()) == sorted(set(classes.values()))
