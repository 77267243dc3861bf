"""Leaks against brute force over word windows; templates; edge rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shellgauge.llm import decontamination as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("most", [200_000, 0])
def test_documents(spark, monkeypatch, most):
    monkeypatch.setattr(q, "MAX_DROPPED", most)
    monkeypatch.setattr(q, "TOKENS", 5000)
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    windows, total = defaultdict(set), {}
    for r in items.collect():
        w = r["text"].lower().split()
        total[r["item_id"]] = len(w) - 7
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].add(r["item_id"])
    want = set()
    for r in docs.collect():
        w, found = r["text"].lower().split(), Counter()
        for i in range(len(w) - 7):
            for item in windows.get(tuple(w[i : i + 8]), ()):
                found[item] += 1
        want |= {(r["doc_id"], k) for k, n in found.items() if n >= min(6, 0.5 * total[k])}
    got = {(r["doc_id"], r["item_id"]) for r in q.contaminated(docs, items).collect()}
    assert want and want <= got
    assert all(d in {x for x, _ in want} for d, _ in got)
    left = {r["doc_id"] for r in q.drop_contaminated(docs, items).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, _ in got}


QUESTION = "If Alice buys 12 apples for 3 dollars and Bob takes 5 of them, how many apples does Alice keep in the end?"


def test_templates_and_slots(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "Short question about whales, please?"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10"), (1, QUESTION)], "item_id long, text string")
    rows = [
        (1, "intro. " + QUESTION.replace("Alice", "Carol").replace("12", "40").replace("Bob", "Dave").replace("dollars", "euros") + " tail"),
        (2, QUESTION.replace("does Alice", "does Bob")),
        (3, None), (4, ""), (5, "11 12 13 14 15 16 17 18 19 20"), (6, "x short question about whales, please? y"), (7, "short question about sharks, please?"),
        (8, QUESTION.upper()), (8, QUESTION.upper()), (None, QUESTION), (9, "unrelated " * 5000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("row", F.lit("x"))
    got = Counter((r["doc_id"], r["item_id"]) for r in q.contaminated(df, items).collect())
    assert got[(1, 1)] == 2 and got[(None, 1)] == 2 and got[(6, 2)] == 1
    # 11 of the 16 windows of the second are the question's own, whatever its last name
    assert got[(2, 1)] == 2 and not {3, 4, 5, 7, 9} & {d for d, _ in got}
    kept = q.drop_contaminated(df, items)
    assert kept.columns == df.columns and {1, 2, None, 6}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    one = spark.createDataFrame([(1, 1, QUESTION)], "doc_id long, item_id long, text string")
    assert q.contaminated(none, one).collect() == [] and q.contaminated(one, none).collect() == []
    assert q.drop_contaminated(one, none).count() == 1 and q.drop_contaminated(none, one).count() == 0


PASSAGE = " ".join(f"{a}{b}" for a in "qwrtpsdfgh" for b in ("alo", "emi", "oru", "ubi", "ine", "ova")).split()


def test_changed_values(spark):
    passage = [*PASSAGE[:10], "12", *PASSAGE[11:40], "12", *PASSAGE[41:]]
    shared = "a farmer has 4 friends who each bring 4 more baskets of pears to the market in town on a sunny morning in june this year"
    items = spark.createDataFrame([(1, " ".join(passage)), (2, shared), (3, "we know that 3 red boxes and 5 blue boxes were moved to the old house near the long river that day")], "item_id long, text string")
    rows = [
        (1, " ".join([*passage[:40], "13", *passage[41:]])),
        (2, shared.replace("4 friends", "7 friends").replace("4 more", "9 more")),
        (3, "we know that 4 red boxes and 4 blue boxes were moved to the old house near the long river that day"),
        (4, "a farmer has 4 cats"),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["windows"]) for r in q.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)}
    assert got[1, 1] == (53, 53) and got[2, 2][0] == got[2, 2][1]


def test_new_name_near_the_end(spark):
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    docs = spark.createDataFrame([(1, QUESTION.replace("does Alice", "does Carol"))], "doc_id long, text string")
    assert [r["matched"] for r in q.contaminated(docs, items).collect()] == [16]


def test_names_that_conflict_in_every_window(spark):
    item = "we asked whether Alice saw Bob before Alice told Bob that Alice or Bob would let Alice and Bob go home with Alice then"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("Alice", "Carol").replace("Bob", "Carol")), (2, item.replace("Alice", "Carol")), (3, item)]
    assert {r["doc_id"] for r in q.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()} == {2, 3}


def test_repeated_window_counts_once(spark):
    items = spark.createDataFrame([(1, " ".join(PASSAGE[:29]))], "item_id long, text string")
    line = " ".join(PASSAGE[4:12])
    docs = spark.createDataFrame([(1, "\n".join(f"{w} {line} {w}" for w in "abcdef")), (2, " ".join(PASSAGE[4:17]))], "doc_id long, text string")
    assert [(r["doc_id"], r["matched"]) for r in q.contaminated(docs, items).collect()] == [(2, 6)]


def test_other_capitals_and_line_ends(spark):
    short = "What is the capital city of France"
    items = spark.createDataFrame([(1, QUESTION), (2, short)], "item_id long, text string")
    rows = [
        (1, QUESTION.lower()), (2, QUESTION.upper()), (3, f"a heading\n{short}\nParis"), (4, f"a heading\n{short.replace('France', 'Spain')}\nMadrid"),
        (5, QUESTION.replace(" ", "\n")), (6, "what is the capital city\nof"), (7, QUESTION.replace("apples", "pears")),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["windows"]) for r in q.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): (16, 16), (2, 1): (16, 16), (3, 2): (1, 1), (4, 2): (1, 1), (5, 1): (16, 16)}
