"""Scans and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from shellgauge.sources import logs, sinks

RECORDS = [
    json.dumps({"kind": "event", "ts": "2025-01-01T00:00:00Z", "tool_name": "Bash", "tool_use_id": "a", "command": "ls",
                "final": "allow", "provisional": {"strict": "ALLOW", "balanced": "ALLOW", "auto": "ALLOW"},
                "fired_rules": [{"id": "SE-P-001"}], "judge": {"answers": {"x": 1}, "tier": "T6"}}),
    "", "not json", json.dumps({"kind": "error", "stage": "judge"}), json.dumps({"kind": "event"}),
    json.dumps({"kind": "event", "tool_name": "Read", "tool_input": {"file_path": "/x"}, "provisional": "WARN"}),
]


def test_event_log(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(RECORDS) + "\n")
    rows = logs.scan_event_log(spark, str(tmp_path))
    got = sorted((r.file.rsplit("/", 1)[1], r.line, r.reason or "") for r in rows.collect())
    per_file = [(1, ""), (3, "not JSON"), (4, "not an event (kind=error)"), (5, "no tool_name"), (6, "")]
    assert got == [(f"{f}.jsonl", *x) for f in "ab" for x in per_file]
    typed = {r.tool_name: r for r in logs.log_columns(rows).filter(F.col("file").endswith("a.jsonl")).collect()}
    assert typed["Bash"].rule_ids == ["SE-P-001"] and typed["Bash"].has_answers and typed["Bash"].tier == "T6"
    assert json.loads(typed["Read"].tool_input) == {"file_path": "/x"} and typed["Read"].provisional is None


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("\n".join(f'{{"n": {i}}}' for i in range(1, 5001)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.scan_lines(spark, str(path))
        wrong = rows.filter(F.get_json_object("value", "$.n").cast("bigint") != F.col("line")).count()
        assert rows.count() == 5000 and wrong == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_answer_cache(spark, tmp_path):
    folder = tmp_path / "judge-1" / "abcd"
    folder.mkdir(parents=True)
    answers = {"b": {"type": "choice", "choice": "x", "probabilities": {"y": 0.25, "x": 0.75}},
               "a": {"type": "score", "score": 2.0, "legend": {"0": "", "1": "", "2": ""}}}
    (folder / "s1.json").write_text(json.dumps({"answers": answers, "model": "judge-1", "error": None, "cache_version": 1}))
    (folder / "s2.json").write_text(json.dumps({"answers": {}, "model": "judge-1", "error": "timeout", "cache_version": 1}))
    (folder / "s3.json").write_text(json.dumps({"answers": {}, "model": "judge-1", "cache_version": 9}))
    rows = logs.scan_answer_cache(spark, str(tmp_path / "*" / "*")).collect()
    assert [(r.model_dir, r.rubric_hash, r.state_hash) for r in rows] == [("judge-1", "abcd", "s1")]
    by_axis = {a.axis: a for a in rows[0].answers}
    assert by_axis["b"].labels == ["y", "x"] and by_axis["b"].probs == [0.25, 0.75]
    assert by_axis["a"].legend == ["0", "1", "2"]


def rule_file(path, total):
    rule = {"rule_id": "R1", "description": "d", "failure_family": "F1", "mitre_techniques": ["T1"], "confidence": 0.9,
            "provenance_tier": "mitre", "pattern_regex": "rm"}
    path.write_text(json.dumps({"_meta": {"version": "1", "date": "2025", "total_rules": total}, "rules": [rule]}))


def test_rule_bank(spark, tmp_path):
    rule_file(tmp_path / "good.json", 1)
    row = logs.scan_rule_bank(spark, str(tmp_path / "good.json")).head()
    assert (row.rules_version, row.ord, row.rule_id) == ("1+2025", 0, "R1")
    rule_file(tmp_path / "bad.json", 2)
    with pytest.raises(Exception, match="total_rules"):
        logs.scan_rule_bank(spark, str(tmp_path / "bad.json")).collect()


def test_corpus(spark, tmp_path):
    (tmp_path / "c.txt").write_text('# note\n\nls -la\njson:"cat <<E\\n$(date)\\nE"\n')
    got = [r.command for r in logs.scan_command_corpus(spark, str(tmp_path / "c.txt")).collect()]
    assert got == ["ls -la", "cat <<E\n$(date)\nE"]


def test_decision_log_bounds_files_per_date(spark, tmp_path):
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    sinks.decision_log(rows, str(tmp_path / "log"), files_per_date=4)
    files = list((tmp_path / "log" / "event_date=2023-11-14").glob("*.parquet"))
    assert 1 <= len(files) <= 4 and spark.read.parquet(str(tmp_path / "log")).count() == 1000
