"""Alignment of two tokenizers against a plain version."""

import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from shellgauge.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox", "The quick brown fox", "", None, "naïve façade — 東京 😀", "a  b   c\n\n\td", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "▁ is the mark itself", " leading and trailing ", "x" * 3000, "word " * 2000, "\x00\x01 control   ends", "1234567890 12.5%", "a\r\nb", "ﬁ ligature ™",
]


@functools.cache
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts):
    t, p = libraries()
    to_byte = {c: b for c, b in alignment.byte_of_character().items()}
    per = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.encode(text) if text else []
        bytes_a = [bytes(to_byte[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            per.append(([], [], [], ""))
            continue
        ends_a, ends_b = (list(np.cumsum([len(x) for x in parts])) for parts in (bytes_a, bytes_b))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        per.append((a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(x for _, _, links, _ in per for x in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (len(a), len(b), len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for a, b, links, digest in per
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_bytes_of_characters():
    table = alignment.byte_of_character()
    assert sorted(table.values()) == list(range(256)) and set(table) == set(ByteLevel.alphabet())


@pytest.fixture(scope="module")
def encoders():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return alignment.Encoders(a.read(), b.read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab'sétlé 1²½\n\t \u00a0\x1c\x85\u2028ß", max_size=30), st.text("aehinorst' ", max_size=40)), max_size=5))
def test_parts_encode_as_the_whole(encoders, texts):
    """Ids are the two libraries' own, though texts are encoded in parts and by another engine."""
    t, _ = libraries()
    assert encoders.quick is not None and encoders.apart
    for text, x in zip(texts, encoders.align(texts)):
        if len(x.a):
            assert x.a.tolist() == t.encode(" " + text, add_special_tokens=False).ids and x.b.tolist() == encoders.b.encode(text)
    assert [len(x.a) for x in encoders.align(texts)] == [m[0] for m in brute(texts)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 4000), min_size=1, max_size=500), st.sets(st.integers(1, 4000), min_size=1, max_size=500))
def test_common_ends(a, b):
    a, b = np.array(sorted(a)), np.array(sorted(b))
    in_a, in_b = alignment.common_ends(a, b)
    want = np.intersect1d(a, b)
    assert (a[in_a] == want).all() and (b[in_b] == want).all() and len(in_a) == len(want)


def test_common_ends_of_unequal_lists():
    few, many = np.array([5, 70_000, 999_999]), np.arange(1, 1_000_000)
    in_a, in_b = alignment.common_ends(few, many)
    assert in_a.tolist() == [0, 1, 2] and in_b.tolist() == [4, 69_999, 999_998]
    in_b, in_a = alignment.common_ends(many, few)
    assert in_a.tolist() == [0, 1, 2] and in_b.tolist() == [4, 69_999, 999_998]
    assert [len(x) for x in alignment.common_ends(few, few[:0])] == [0, 0]


@pytest.mark.parametrize(("head", "flush"), [(200_000, 300_000), (5, 4), (0, 50)])
def test_measures_equal_the_plain_version(spark, monkeypatch, head, flush):
    monkeypatch.setattr(alignment, "FLUSH", flush)
    monkeypatch.setattr(alignment, "frequent_pairs", lambda counted, f=alignment.frequent_pairs: f(counted, head))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.measure(docs, A, B).collect()}
    assert got == dict(enumerate(brute(TEXTS)))
    assert got[7][0] == 0 and got[6][0] > 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.measure(docs, A, B).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows])))


def test_groups_cover_all_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.align(docs, A, B).collect():
        assert [g["first_a"] for g in r["groups"]] == [sum(g["n_a"] for g in r["groups"][:k]) for k in range(len(r["groups"]))]
        assert sum(g["n_a"] for g in r["groups"]) == len(r["a"]) and sum(g["n_b"] for g in r["groups"]) == len(r["b"])


def test_empty_clashing_and_repeated(spark):
    docs = spark.createDataFrame([(None, "a b", 1, 2), (None, "a b", 3, 4), (1, None, 5, 6)], "doc_id long, text string, row long, pairs long")
    got = sorted(tuple(r) for r in alignment.measure(docs, A, B).select("n_a", "n_links", "count_sum", "groups_sha256").collect())
    assert got[0] == (0, 0, 0, "") and got[1] == got[2] and got[1][:3] == (2, 2, 4)
    assert alignment.measure(docs.limit(0), A, B).collect() == []
