"""Canonicalization: exact values for rewrites, decoders and view order."""

import base64

import pytest
from pyspark.sql import functions as F

from shellgauge.operators import canon


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).head().r


def texts(spark, command):
    return [v.text for v in one(spark, command, canon.views)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("rm${IFS}-rf${IFS}/tmp", "rm -rf /tmp"),
        ("cat$IFS/etc/passwd", "cat /etc/passwd"),
        ("x$IFSsh", "x sh"),
        ("plain  text", "plain text"),
    ],
)
def test_ifs(spark, text, want):
    assert one(spark, text, canon.expand_ifs) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("$(echo curl) -s x", "curl -s x"),
        ('$(c""url) -fsSL x', "curl -fsSL x"),
        ("`echo curl` -s x", "curl -s x"),
        ("$(printf 'rm') -rf /", "rm -rf /"),
        ("$($(echo echo) ls) x", "ls x"),
        ("a$()b", "ab"),
        ("echo $(date)", "echo $(date)"),
    ],
)
def test_collapse(spark, text, want):
    assert one(spark, text, canon.collapse_substitution) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ('_z0="cur";_z1="l";$_z0$_z1 -fsSL http://e/i', '_z0="cur";_z1="l";curl -fsSL http://e/i'),
        ("a=rm; a=ls; $a ${b} $c", "a=rm; a=ls; ls ${b} $c"),
        ("a='x|y'; $a", "a='x|y'; $a"),
    ],
)
def test_variables(spark, text, want):
    assert one(spark, text, canon.expand_variables) == want


def test_decoders(spark):
    assert "rm -rf /" in texts(spark, "eval $(echo 'cm0gLXJmIC8=' | base64 -d)")
    assert "rm -rf" in texts(spark, r"printf '\x72\x6d\x20\x2d\x72\x66' | sh")
    assert "cat" in texts(spark, r"printf '\0143\0141\0164' | sh")
    assert texts(spark, r"printf '\0777' | sh") == [r"printf '\0777' | sh"]
    assert texts(spark, "bash -c 'rm -rf /'") == ["bash -c 'rm -rf /'", "rm -rf /"]
    assert texts(spark, "busybox sh -c 'ls a'")[1:] == ["ls a"]
    assert texts(spark, "bash -c 'unterminated") == ["bash -c 'unterminated"]
    assert "cat /etc/passwd" in texts(
        spark, "python3 -c \"import base64,os;os.system(base64.b64decode('Y2F0IC9ldGMvcGFzc3dk').decode())\""
    )


def test_views_are_breadth_first_bounded_and_linked(spark):
    inner = base64.b64encode(b"bash -c 'ls${IFS}x'").decode()
    vs = one(spark, f"echo {inner} | base64 -d | sh", canon.views)
    assert [(v.kind, v.text, v.depth, v.parent) for v in vs] == [
        ("raw", f"echo {inner} | base64 -d | sh", 0, None),
        ("b64_dec", "bash -c 'ls${IFS}x'", 1, 0),
        ("rewritten", "bash -c 'ls x'", 1, 1),
        ("shell_c", "ls x", 2, 2),
    ]
    many = " ; ".join(f"sh -c 'echo {i}'" for i in range(40))
    assert len(texts(spark, many)) == canon.MAX_VIEWS


def test_long_text_does_not_overflow(spark):
    long = "echo " + "'a b' \"c d\" \\x " * 20000
    assert texts(spark, long + " sh -c 'rm -rf /'")[-1] == "rm -rf /"
