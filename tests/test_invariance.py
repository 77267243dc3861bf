"""Results do not depend on partitions; plans keep their shape."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shellgauge.catalogs.axes import builtin_axes
from shellgauge.catalogs.profiles import PAPER
from shellgauge.operators import replay
from shellgauge.plans.analyze import analyze, decide, layer_evidence, layer_scores
from shellgauge.plans.judging import adjudicate
from shellgauge.sources import adapters

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_invariance(spark):
    commands = adapters.commands(spark, SF)
    cols = ["cmd_id", "aggregate", "final", "skip_predicate", "fixes_applied"]
    runs = [sorted(map(tuple, analyze(commands.repartition(n), PAPER).select(*cols).collect()), key=repr) for n in (1, 4, 64)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 1000


def test_static_pipeline_has_no_shuffle(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("event_id").alias("cmd_id"), F.concat(F.lit("rm -rf /srv/"), F.col("user_id")).alias("command"))
    plan = plan_of(analyze(events, PAPER).select("cmd_id", "final"))
    assert "Exchange" not in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_answers_need_no_join(spark):
    from shellgauge.operators.answers import evaluate

    axes = builtin_axes()
    plan = plan_of(evaluate(adapters.answer_items(spark, SF, axes), axes).select("item_id", "verdict"))
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_sweep_reads_cells(spark):
    scored = layer_scores(layer_evidence(adapters.commands(spark, SF), PAPER))
    cells = replay.score_cells(scored.withColumn("label", F.col("cmd_id") % 2), "label")
    assert cells.count() < 120 and cells.agg(F.sum("n")).head()[0] == 1000


def test_judges(spark):
    commands = adapters.commands(spark, SF)
    done = decide(layer_scores(layer_evidence(commands, PAPER)), PAPER).select("cmd_id", "command", "final", "would_adjudicate", "judge_prompt")
    warn = {r.cmd_id for r in done.filter("would_adjudicate").collect()}
    stub = {r.cmd_id: r.final for r in adjudicate(done, "stub").collect()}
    assert len(stub) == 1000 and {stub[i] for i in warn} == {"unadjudicated"}

    def judge(prompts):
        return prompts.map(lambda p: "SAFE" if "rsync" in p else "<think>")

    text = {r.cmd_id: r for r in adjudicate(done, "text", judge=judge).collect()}
    assert {text[i].final for i in warn} == {"allow", "deny"}
    assert all((text[i].final == "allow") == ("rsync" in text[i].command) for i in warn)
    assert {tuple(text[i].judge_tags) for i in warn if text[i].final == "deny"} == {("FIX-004",)}

    def broken(prompts):
        raise TimeoutError("timeout")

    failed = {r.cmd_id: r for r in adjudicate(done, "text", judge=broken).collect()}
    assert {failed[i].final for i in warn} == {"deny"} and {tuple(failed[i].judge_tags) for i in warn} == {("FIX-008",)}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1000 and df.columns[0] == "cmd_id"
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130
