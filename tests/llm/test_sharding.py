"""Shards: smallest capacity, whole groups, gapless slots."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shellgauge.llm import sharding

SF = "/root/testdata/sf0.001"


def brute_capacity(sizes, shards):
    best = {0: 0}
    for k in range(shards):
        new = {}
        for i, worst in best.items():
            for j in range(i, len(sizes) + 1):
                c = max(worst, sum(sizes[i:j]))
                if c < new.get(j, 1 << 60):
                    new[j] = c
        best = new
    return best[len(sizes)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_smallest_capacity(sizes, shards):
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    capacity = sharding.smallest_capacity(bounds, shards)
    assert capacity == brute_capacity(sizes, shards)
    cuts = sharding.cut_evenly(bounds, capacity, shards)
    assert len(cuts) == shards + 1 and (np.diff(cuts) >= 0).all() and (np.diff(bounds[cuts]) <= capacity).all()


@pytest.mark.parametrize("ranges", [16, 1 << 14])
def test_documents(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(docs, shards=7).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    groups, by = defaultdict(set), defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        groups[raw].add(r["shard"])
        by[r["shard"]].append(r)
    assert all(len(s) == 1 for s in groups.values())
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    hashes = docs.selectExpr("xxhash64(text) & 9223372036854775807 AS h", "octet_length(text) + 16 AS s").groupBy("h").sum("s").orderBy("h").collect()
    bounds = np.concatenate([[0], np.cumsum([r[1] for r in hashes])])
    assert max(sum(r["size"] for r in own) for own in by.values()) == sharding.smallest_capacity(bounds, 7)


def test_nulls_ties_repeats_and_clashes(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "a" * 5000, 7), (3, "b", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long").withColumnRenamed("size", "h")
    got = sharding.shard(df, shards=3).collect()
    assert len(got) == 5 and {r["shard"] for r in got} <= {0, 1, 2}
    assert len({r["shard"] for r in got if r["size"] == 16}) == 1
    assert [r["text_crc32"] for r in got if r["size"] == 16] == [0, 0, 0]


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
