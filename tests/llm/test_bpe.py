"""Encoding equals the tokenizers library; decoding joins the tokens."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shellgauge.llm import bpe
from shellgauge.llm.queries import TOKENIZER

SAMPLES = [
    "", " \t\n", "Hello, world! It's 2024.", "ΣΑΣ ΟΔΟΣ", "İstanbul ẞ ﬁ", "a<|endoftext|>b <|startoftext|>", "日本語 テキスト 🙂👍🏽",
    "x" * 3000, "thequick" * 200, "é́ñ　 a\x1cb\x1fc\x00", "don't we'll they're I'D", "½Ⅷ٣", "THE!! END.!!", "a\u2028b\u0085c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_ids_and_text_equal_the_library(spark, library):
    rows = [(i, t) for i, t in enumerate(SAMPLES)] + [(0, SAMPLES[2]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    got = bpe.decode(bpe.encode(df, TOKENIZER), TOKENIZER).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want
    for r in got:
        assert r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False)


def test_random_texts(library):
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(TOKENIZER))
    chunks = bpe.Cache(vocabulary)
    dice = random.Random(5)
    letters = "abcxyzÉéÜßΣσςİı 'strvemld019٣½中文🙂́　\t\n<|startoftext|>"
    for _ in range(1500):
        text = "".join(dice.choice(letters) for _ in range(dice.randint(0, 50)))
        got = memoryview(vocabulary.encode(text, chunks)).cast("i").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_heap_equals_scan():
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(TOKENIZER))
    dice = random.Random(6)
    for _ in range(300):
        word = "".join(dice.choice("etaoinshrdlu") for _ in range(dice.randint(2, 90))) + bpe.END
        bounds = [*range(len(word) - 1), len(word)]
        assert vocabulary.scan(word, bounds[:]) == vocabulary.heap(word, bounds[:])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(df, TOKENIZER).collect() == []


def test_small_cache_changes_nothing(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(TOKENIZER))
    chunks = bpe.Cache(vocabulary)
    text = "one two three four five six one two three four five six " * 3
    assert memoryview(vocabulary.encode(text, chunks)).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(chunks) <= 3 and len(chunks.old) <= 3
