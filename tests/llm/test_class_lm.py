"""Base scores against plain counts; the model is a distribution and beats the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellgauge.llm import class_lm as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def check(rows, texts):
    tokens = [(k, [*WORD.findall((t or "").translate(LOWER)), None]) for k, t in texts]
    counts = Counter(w for k, ws in tokens if not held(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    total = n + 0.1 * (v + 1)
    want = sorted(
        (str(k), held(k), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / total) for w in ws), 4)) for k, ws in tokens
    )
    got = sorted((str(r[0]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=2e-4)


@pytest.mark.parametrize("head", [200_000, 50])
def test_documents(spark, monkeypatch, head):
    monkeypatch.setattr(q, "HEAD", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = q.score(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def learned(spark, texts):
    """Head, classes, transitions' terms and every training word's count and class of a list of texts."""
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = q.count_words(df).cache()
    head, classes, table = q.learn_classes(counted, df)
    rows = table.collect()
    assert len({bytes(r["word"]) for r in rows}) == len(rows)
    c = {bytes(r["word"]): r["c"] for r in rows}
    assert {**c, b"": len(texts)} == {bytes(r["word"]): r["c"] for r in counted.collect()}
    of = {**{bytes(r["word"]): r["k"] for r in rows}, b"": 0}
    joint = q.transitions(q.class_sequences(df.selectExpr("1 AS key", "t"), head, classes, table, True))
    n, v = sum(c.values()) + len(texts), len(c) + 1
    return head, classes, of, c, joint, q.pair_terms(joint, table, len(texts), n, v), (n, v)


def words_of(text):
    return [w.encode() for w in WORD.findall((text or "").translate(LOWER))]


def test_model_is_a_distribution(spark):
    """After any class, the words of the vocabulary and one unseen word per class have probability one at most."""
    _, classes, of, c, _, terms, _ = learned(spark, ["a b c a b d", "a b e f g", "x Y z x y"])
    for before in set(of.values()):
        mass = sum((k + q.ADDED) * 10 ** terms[before, of[w]] for w, k in {**c, b"": 3}.items())
        assert 0.3 < mass <= 1 + 1e-9


@pytest.mark.parametrize("head", [200_000, 60])
def test_score_by_brute_force(spark, monkeypatch, head):
    """Transitions, emissions and scores counted plainly from the classes found, with words in and beyond the head."""
    monkeypatch.setattr(q, "HEAD", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300).collect()
    train = [words_of(r["text"]) for r in docs if not held(r["doc_id"])]
    _, classes, of, c, joint, terms, (n, v) = learned(spark, [r["text"] or "" for r in docs if not held(r["doc_id"])])
    k = q.CLASSES + 1
    want = np.zeros((k, k))
    for ws in train:
        seq = [0, *(of[w] for w in ws), 0]
        for x, y in zip(seq, seq[1:]):
            want[x, y] += 1
    assert np.array_equal(joint, want)
    size, distinct = Counter({0: len(train)}), Counter({0: 1})
    for w, x in c.items():
        size[of[w]] += x
        distinct[of[w]] += 1
    count = {**c, b"": len(train)}

    def plain(ws):
        total, before = 0.0, 0
        for w in [*ws, b""]:
            now = of[w] if w in of else classes.of_group[zlib.crc32(w[-3:]) % q.GROUPS]
            move = (want[before, now] + q.TRANSITION) / (want[before].sum() + q.TRANSITION * k)
            p = q.MIX * move / (size[now] + q.ADDED * (distinct[now] + 1)) + (1 - q.MIX) / (n + q.ADDED * (v + 1))
            total += math.log10((count.get(w, 0) + q.ADDED) * p)
            before = now
        return total

    got = {r["doc_id"]: r["score"] for r in q.score(spark.createDataFrame(docs)).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert math.isclose(got[r["doc_id"]], plain(words_of(r["text"])), rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("head", [200_000, 30])
def test_every_word_is_exchanged(spark, monkeypatch, head):
    """Each word beyond the units moves to the class that its neighbours, counted plainly, like best."""
    monkeypatch.setattr(q, "HEAD", head)
    monkeypatch.setattr(q, "FLUSH", 50)
    dice = np.random.default_rng(3)
    sides = [[f"{s}{i:03d}{'abcdefgh'[i % 8]}" for i in range(120)] for s in ("na", "ve")]
    texts = [" ".join(sides[j % 2][min(int(dice.zipf(1.3)) - 1, 119)] for j in range(60)) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    counted = q.count_words(df).cache()
    most = [x for x in q.most_frequent(counted, q.HEAD) if x[0] != b""]
    head_words = q.Head([*(w for w, _ in most), b""], np.zeros(len(most) + 1))
    unit = {w: i + 1 for i, (w, _) in enumerate(most[: q.FREQUENT])}
    pairs = q.neighbour_counts(df, [w for w, _ in most[: q.FREQUENT]])
    of_unit = q.exchange(pairs)
    first = q.Classes(np.array([of_unit[unit.get(w) or q.group_of(w)] for w, _ in most] + [0]), of_unit[1 + q.FREQUENT :])
    member = np.zeros((q.UNITS, q.CLASSES + 1))
    member[np.arange(q.UNITS), of_unit] = 1
    joint = member.T @ pairs @ member
    table, classes = q.exchange_words(df, head_words, first, joint)
    got = {bytes(r["word"]): r["k"] for r in table.collect()}
    gain, k = q.gains(joint), q.CLASSES + 1
    in_head = {w: i for i, w in enumerate(head_words.words)}
    start = {w: first.of_head[in_head[w]] if w in in_head else first.of_group[zlib.crc32(w[-3:]) % q.GROUPS] for w in [*got, b""]}
    now, moved = dict(start), 0
    for part in range(q.PARTS):
        near = {w: np.zeros(2 * k) for w in got}
        for t in texts:
            ws = [b"", *words_of(t), b""]
            for i in range(1, len(ws) - 1):
                near[ws[i]][now[ws[i + 1]]] += 1
                near[ws[i]][k + now[ws[i - 1]]] += 1
        for w in got:
            if zlib.crc32(w) % q.PARTS == part:
                value = near[w] @ gain
                value[0] = -np.inf
                value[start[w]] += q.STAY
                assert value[got[w]] >= value.max() - 1e-6
                moved += got[w] != start[w]
        now.update({w: got[w] for w in got if w in in_head and zlib.crc32(w) % q.PARTS == part})
    assert moved > 0 or head > len(got)
    assert [classes.of_head[i] for w, i in in_head.items()] == [now[w] for w in in_head]


def test_exchange_finds_alternating_classes():
    dice = np.random.default_rng(1)
    pairs = np.zeros((41, 41))
    for _ in range(20_000):
        a = dice.integers(1, 21)
        b = dice.integers(21, 41)
        pairs[a, b] += 1
        pairs[b, dice.integers(1, 21)] += 1
    of = q.exchange(pairs, classes=2)
    assert of[0] == 0 and len(set(of[1:21])) == 1 and len(set(of[21:])) == 1 and of[1] != of[40]


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(q, "FLUSH", 2)
    monkeypatch.setattr(q, "TOKENS", 3)
    texts = [(1, None), (2, ""), (None, "A b É é"), (3, "b " * 10_000), (3, "b " * 10_000), (4, "q\x1cr s t\x0bu")] + [(i, "a b c") for i in range(10, 40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("tail", F.lit("x"))
    check(q.score(df).collect(), texts)
    assert q.score(df.limit(0)).collect() == []
    alone = next(i for i in range(1000) if held(i))
    rows = q.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert rows[0]["train_tokens"] == 0 and rows[0]["n_known"] == 0 and abs(rows[0]["base_score"]) < 1e-9 and abs(rows[0]["score"]) < 1e-9
