"""The mix: targets, the order of slots, ranks in closed form, and the words taken."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shellgauge.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, g string, position long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash", -1) for r in rows], SCHEMA)


def brute_targets(sizes, weights, most):
    """Share by weight, cap what is above, share again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        rest = sum(weight[s] for s in order if s not in capped)
        share = {s: left * weight[s] / rest for s in order if s not in capped}
        above = [s for s, t in share.items() if t > most * sizes[s]]
        if not above:
            return share | capped
        capped |= {s: most * sizes[s] for s in above}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "é", "z", "", "Z"])), st.integers(0, 400), min_size=1))
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, f"={s}" if s is not None else "", n) for s, n in sizes.items()], "source string, g string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.MOST_REPEATS)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_schedule_is_van_der_corput(spark):
    runs = [("a", 0, 13), ("b", 13, 1), ("c", 14, 0), ("d", 14, 37)]
    total = 51
    sources = spark.createDataFrame([(*r, total) for r in runs], "g string, first long, cells long, all_cells long")
    got = sorted((r["position"], r["g"], r["block"]) for r in mixing.schedule(sources).collect())
    bits = (total - 1).bit_length()
    want, ranks = [], Counter()
    for k in range(1 << bits):
        cell = int(format(k, f"0{bits}b")[::-1], 2)
        owner = [g for g, first, n in runs if first <= cell < first + n]
        if owner:
            want.append((len(want), owner[0], ranks[owner[0]]))
            ranks[owner[0]] += 1
    assert got == want
    # every stretch holds each source in near its share
    for at in range(0, 40, 8):
        part = Counter(g for _, g, _ in got[at : at + 12])
        assert abs(part["d"] - 12 * 37 / 51) < 3


def test_chunks_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 7)
    sources = spark.createDataFrame([("a", 0, 100, 105), ("b", 100, 5, 105)], "g string, first long, cells long, all_cells long")
    got = mixing.schedule(sources).collect()
    assert sorted(r["position"] for r in got) == list(range(105))
    assert sorted(r["block"] for r in got if r["g"] == "a") == list(range(100))


ROWS = (
    [(i, "w " * (i % 17), "hot") for i in range(300)]
    + [(1000 + i, "x y z", "b") for i in range(9)]
    + [(2000, "long " * 5000, "c"), (2001, "", "c"), (2002, None, "c"), (None, "no key here", None), (None, "no key here", None)]
    + [(3000, "twice same", ""), (3000, "twice same", ""), (3001, " \t\n ", "only blank")]
)


@pytest.mark.parametrize("buckets", [10_000, 5])
def test_taken_words(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", buckets)
    docs = table(spark, ROWS).repartition(3)
    got = mixing.taken(docs, block_words=16).collect()
    assert len(got) == len(ROWS)
    size = lambda t: len((t or "").split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += size(t)
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.MOST_REPEATS)
    per = defaultdict(int)
    source = {(i, size(t)): s for i, t, s in ROWS}
    for r in got:
        s = source[(r["doc_id"], r["size"])]
        per[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    for s, t in want.items():
        assert abs(per[s] - t) <= 0.5
    again = mixing.taken(docs.repartition(5), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_taken_equals_the_tape(spark):
    """Words taken are those of the repeated tape up to the target, whatever the blocks."""
    rows = [(i, "w " * (1 + i % 11), "abc"[i % 3]) for i in range(90)]
    got = {r["doc_id"]: r["taken"] for r in mixing.taken(table(spark, rows), block_words=4).collect()}
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.MOST_REPEATS)
    for s in "abc":
        tape = [i for i, t, _ in sorted(((i, t, x) for i, t, x in rows if x == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()) for _ in t.split()]
        taken = Counter((tape * 3)[: round(want[s])])
        assert all(got[i] == taken[i] for i in set(tape))


def test_mix_lists_the_same_words(spark):
    docs = table(spark, ROWS)
    mixed = mixing.mix(docs, block_words=16)
    sums = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("first")).alias("n")).collect()}
    taken = Counter()
    for r in mixing.taken(docs, block_words=16).collect():
        taken[r["doc_id"]] += r["taken"]
    assert sums == {k: n for k, n in taken.items() if n}
    per_slot = mixed.groupBy("position").agg(F.sum(F.col("stop") - F.col("first")).alias("n")).collect()
    assert all(r["n"] <= 16 for r in per_slot) and sum(r["n"] < 16 for r in per_slot) <= 6


def test_empty_table(spark):
    assert mixing.taken(table(spark, []).limit(0)).collect() == []
    only = mixing.taken(table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in only) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_no_python_in_the_plan(spark):
    plan = mixing.taken(table(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
