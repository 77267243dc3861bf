"""Phrases against a plain count of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shellgauge.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, g string, n long"


def brute(rows, least=10, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash", "clash", -5) for i, (t, g) in enumerate(rows)], SCHEMA)


def found(docs, **kw):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in names) for r in collocations.collocations(docs, **kw).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 4), st.integers(0, 4)), max_size=200), st.integers(1, 12), st.integers(0, 2))
def test_prefix_counts(triples, least, split):
    keys = np.array([(a, b, c if b else 0) for a, b, c in triples], dtype=np.int64).reshape(-1, 3)
    n = np.arange(len(keys)) % 3 + 1
    row, length, count = collocations.count_prefixes(keys, n, np.full(len(keys), split), least)
    want = Counter()
    for k, times in zip(keys.tolist(), n.tolist()):
        for d in (1, 2, 3):
            if 0 not in k[:d]:
                want[tuple(k[:d])] += times
    want = {p: c for p, c in want.items() if c >= least or len(p) <= split}
    got = [(tuple(keys[r, :d].tolist()), c) for r, d, c in zip(row.tolist(), length.tolist(), count.tolist())]
    # below a prefix that is split, parts can be abandoned only for what they hold themselves
    assert dict(got) == want and len(got) == len(want)


def test_hash_equals_the_engine(spark):
    rows = spark.createDataFrame([("en", "naïve"), ("", "x"), ("und", "a" * 50)], "g string, w string")
    got = rows.selectExpr("g", "w", "xxhash64(concat_ws('\n', g, w)) AS h").collect()
    assert all(collocations.word_hash(r["g"], r["w"].encode()) == r["h"] % (1 << 64) for r in got)


def test_blocks_of_suffixes():
    words = [b"", b"a", b"bb", "é".encode()]
    triples = [np.array(x) for x in ([1, 1, 3], [2, 3, 1], [0, 2, 1])]
    numbers = collocations.Numbers()
    keys, n, split = collocations.unpacked(collocations.packed(words, triples, np.array([5, 1, 9]), np.array([0, 2, 1])), numbers)
    names = [b"", *list(numbers)[1:]]
    assert [[names[i] for i in row] for row in keys.tolist()] == [[words[i] for i in row] for row in np.array(triples).T.tolist()]
    assert n.tolist() == [5, 1, 9] and split.tolist() == [0, 2, 1]


def test_many_words_in_a_task():
    x = np.array([1 << 22, 3, 0, 1 << 22, 3, 7, 0, 5])
    one, two, three, n = collocations.distinct_triples(x)
    got = dict(zip(zip(one.tolist(), two.tolist(), three.tolist()), n.tolist()))
    assert got == {(1 << 22, 3, 0): 1, (3, 0, 0): 1, (1 << 22, 3, 7): 1, (3, 7, 0): 1, (7, 0, 0): 1, (5, 0, 0): 1}


def corpus():
    rng = random.Random(5)
    rows = []
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ÉX", "naïve", "\x1c", "東京"]
    for _ in range(400):
        words = rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\r\n", "? "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [("New York City is big. new york city!", "en")] * 12 + [("The The the the", "en")] * 15
    rows += [("a b c. b d", "xx")] * 10 + [("b c", "xx")] * 10 + [("b c", "xx")] + [(None, "en"), ("", None), (" . ,", "yy")]
    return rows


@pytest.mark.parametrize(("split", "held", "buckets", "head"), [(200_000, 1 << 20, 500_000, 10_000), (30, 200, 50, 30), (0, 1, 1, 1)])
def test_equal_to_plain_counts(spark, monkeypatch, split, held, buckets, head):
    for name, value in (("SPLIT_ROWS", split), ("HELD", held), ("BUCKET_ROWS", buckets), ("HEAD_PART", head)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus()
    docs = table(spark, rows).repartition(4)
    assert found(docs) == brute(rows)


def test_top_of_each_group(spark):
    rows = corpus()
    assert found(table(spark, rows), top=7) == brute(rows, top=7)


def test_a_word_that_leads_most_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SPLIT_ROWS", 20)
    monkeypatch.setattr(collocations, "BUCKET_ROWS", 10)
    rng = random.Random(1)
    rows = [(" ".join(f"the of x{rng.randint(0, 90)}" for _ in range(20)), "en") for _ in range(60)]
    docs = table(spark, rows).repartition(6)
    assert found(docs) == brute(rows)


def test_exact_products(spark):
    rows = [(10**13, 10**13 + 1, 10**13 + 7), (10, 10, 10), (99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select(collocations.score_of(df["a"], df["l"], df["r"]).alias("s")).collect()
    assert [r["s"] for r in got] == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_empty_table(spark):
    assert found(table(spark, [("a b", "en")]).limit(0)) == []
    assert found(table(spark, [("rare words only", "en"), (None, None)])) == []


def test_long_text(spark):
    rows = [("alpha beta " * 40_000, "en")]
    assert found(table(spark, rows)) == brute(rows)
