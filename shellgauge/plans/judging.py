"""Judges over the unresolved WARN rows: pluggable, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellgauge.catalogs.axes import Axis
from shellgauge.catalogs.profiles import JudgeProfile
from shellgauge.operators import answers as ans
from shellgauge.operators.policy import judge_text_decision, judge_text_denies_older, parse_judge_text
from shellgauge.session import checkpoint

# What a failing judge decides.
FAILURE_DECISION = {"text": "deny", "rubric": "ask", "stub": "unadjudicated"}
Judge = Callable[[pd.Series], pd.Series]


def stub(warn: DataFrame) -> DataFrame:
    """No judge configured."""
    return warn.withColumns({"judge_decision": F.lit("unadjudicated"), "judge_error": F.lit(None).cast("string")})


def text_judge(warn: DataFrame, judge: Judge, prompt: str = "judge_prompt", key: str = "cmd_id") -> DataFrame:
    """Ask a text judge about every row; a call that fails is denied, not the others of its batch.

    A batch is asked at once; when that fails, each half is, down to single rows, so
    the error stays with the row that causes it. Equal prompts of a batch are asked
    once. Only the prompt travels to Python, and replies come back on their rows:
    repeated keys stay apart.
    """
    def replies(prompts: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"reply": list(judge(prompts)), "judge_error": None}, index=prompts.index)
        except Exception as e:  # noqa: BLE001
            if len(prompts) == 1:
                return pd.DataFrame({"reply": [None], "judge_error": [f"judge failed: {e}"]}, index=prompts.index)
            half = len(prompts) // 2
            return pd.concat([replies(prompts.iloc[:half]), replies(prompts.iloc[half:])])

    @F.pandas_udf("struct<reply:string,judge_error:string>")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        if not len(prompts):
            return pd.DataFrame({"reply": [], "judge_error": []})
        number, distinct = pd.factorize(prompts, use_na_sentinel=False)
        return replies(pd.Series(distinct)).iloc[number].reset_index(drop=True)

    asked = warn.withColumn("__asked", ask.asNondeterministic()(F.col(prompt)))
    return decided_by_text(asked.withColumns({"reply": F.col("__asked.reply"), "judge_error": F.col("__asked.judge_error")}).drop("__asked"))


def decided_by_text(replied: DataFrame) -> DataFrame:
    """Rows with ``reply`` and ``judge_error``, and what they come to."""
    return replied.withColumns({
        "judge_decision": F.when(F.col("judge_error").isNotNull(), F.lit(FAILURE_DECISION["text"])).otherwise(
            judge_text_decision(F.coalesce("reply", F.lit("")))),
        "judge_tags": F.array_compact(F.array(F.when(
            F.col("judge_error").isNull() & (parse_judge_text(F.col("reply")) == "unparseable")
            & ~judge_text_denies_older(F.col("reply")), F.lit("FIX-004")),
            F.when(F.col("judge_error").contains("timeout"), F.lit("FIX-008")))),
    })


def rubric_judge(warn: DataFrame, logged: DataFrame, axes: list[Axis], key: str = "cmd_id",
                 profile: JudgeProfile | None = None, params: list[dict] | None = None) -> DataFrame:
    """Judge WARN rows from a table of answers ``key, level, model, answers``; no answer asks.

    Records are evaluated where they lie, so the join moves verdicts instead of
    answers. Give the records of the asked rows alone where the table holds many others.
    """
    judged = ans.evaluate(logged, axes, profile, params).select(
        key, "tier", "tier_rule", "verdict", F.col("error").alias("judge_error"))
    out = warn.join(judged, key, "left")
    return out.withColumn("judge_decision", F.coalesce("verdict", F.lit(FAILURE_DECISION["rubric"]))).drop("verdict")


BACKENDS: dict[str, Callable[..., DataFrame]] = {"stub": stub, "text": text_judge, "rubric": rubric_judge}


def adjudicate(analyzed: DataFrame, backend: str, **options: object) -> DataFrame:
    """Send only unresolved WARN rows to a judge and put their decisions back.

    The analysis is written once, then split: the judge sees the filtered rows
    alone, and neither side analyzes a command again.
    """
    analyzed = checkpoint(analyzed)
    warn = analyzed.filter("would_adjudicate")
    rest = analyzed.filter("not would_adjudicate")
    judged = BACKENDS[backend](warn, **options)
    done = judged.withColumn("final", F.col("judge_decision"))
    return rest.unionByName(done, allowMissingColumns=True)
