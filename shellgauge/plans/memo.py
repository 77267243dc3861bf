"""Answers that are kept: a store of judge replies, and judging through it.

The store is a table of replies in Parquet, one directory for each model and
rubric, and bucketed by the hash of the state a reply was given to. States meet
it bucket by bucket, so stored replies are never shuffled, however many there are:
only the distinct states that are asked about move. A state that is not found is judged
once, whatever the number of rows that hold it, and its reply is appended. Failed
calls are not stored, so they are asked again another time.

A state may be stored twice (two jobs that judged it at the same time): the least
reply counts. Null states read as empty. An empty table asks nothing. A store that
does not exist is made by the first use; any session that knows its folder can use it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellgauge.plans.judging import FAILURE_DECISION, Judge, decided_by_text, text_judge
from shellgauge.session import scratch


SCHEMA = "state_hash STRING, reply STRING, model STRING, rubric_hash STRING"


def state_hash(state: Column) -> Column:
    return F.sha2(F.coalesce(state, F.lit("")).cast("binary"), 256)


@dataclass(frozen=True)
class AnswerStore:
    """Replies of judges in a folder that all executors share."""

    spark: SparkSession
    folder: str
    buckets: int = 32

    @property
    def name(self) -> str:
        """The table's name in this session."""
        return f"answers_{md5(self.folder.encode()).hexdigest()[:16]}"

    def table(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            self.spark.sql(
                f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet PARTITIONED BY (model, rubric_hash)"
                f" CLUSTERED BY (state_hash) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
            # makes the folder where there is none
            self._write(self.spark.createDataFrame([], SCHEMA))
        # partitions that other sessions have added
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame) -> None:
        (rows.write.mode("append").format("parquet").partitionBy("model", "rubric_hash")
         .bucketBy(self.buckets, "state_hash").option("path", self.folder).saveAsTable(self.name))

    def replies(self, model: str, rubric_hash: str) -> DataFrame:
        """``state_hash`` and ``reply``, one row a state, of one model and rubric."""
        own = self.table().filter((F.col("model") == model) & (F.col("rubric_hash") == rubric_hash))
        return own.groupBy("state_hash").agg(F.min("reply").alias("reply"))

    def append(self, replies: DataFrame, model: str, rubric_hash: str) -> None:
        """Add ``state_hash`` and ``reply``: one file a bucket."""
        self.table()
        rows = replies.select("state_hash", "reply", F.lit(model).alias("model"), F.lit(rubric_hash).alias("rubric_hash"))
        self._write(rows.repartition(self.buckets, "state_hash"))

    def lookup(self, states: DataFrame, model: str, rubric_hash: str, how: str = "left") -> DataFrame:
        """States with their stored replies; the stored side stays in its buckets."""
        return states.hint("merge").join(self.replies(model, rubric_hash), "state_hash", how)


def judge_through(
    warn: DataFrame, judge: Judge, store: AnswerStore, model: str, rubric_hash: str, prompt: str = "judge_prompt",
) -> DataFrame:
    """The rows with ``judge_decision``, ``judge_error``, and ``judge_source``: ``cache``, ``judged`` or ``failed``."""
    spark = warn.sparkSession
    known_at, new_at = scratch(spark, "known-states"), scratch(spark, "judged-states")
    hashed = warn.withColumn("__state", state_hash(F.col(prompt)))
    states = hashed.groupBy(F.col("__state").alias("state_hash")).agg(F.first(F.coalesce(prompt, F.lit(""))).alias("state"))
    # whether a state was known is settled before anything is stored
    store.lookup(states, model, rubric_hash).write.parquet(known_at)
    known = spark.read.parquet(known_at)
    asked = text_judge(known.filter("reply is null").select("state_hash", "state"), judge, prompt="state", key="state_hash")
    asked.select("state_hash", "reply", "judge_error").write.parquet(new_at)
    new = spark.read.parquet(new_at)
    store.append(new.filter("judge_error is null and reply is not null"), model, rubric_hash)
    error = F.lit(None).cast("string").alias("judge_error")
    source = F.when(F.col("judge_error").isNull(), "judged").otherwise("failed").alias("judge_source")
    results = known.filter("reply is not null").select("state_hash", "reply", error, F.lit("cache").alias("judge_source")).unionByName(
        new.select("state_hash", "reply", "judge_error", source))
    joined = hashed.join(results.withColumnRenamed("state_hash", "__state"), "__state", "left").drop("__state")
    return decided_by_text(joined)


Backend = Callable[[DataFrame], DataFrame]


def judge_by_backend(warn: DataFrame, backends: dict[str, Backend], backend: str = "backend") -> DataFrame:
    """Each row by the judge its profile names; a row whose judge is not there stays unadjudicated.

    Backends take rows and give them back with ``judge_decision``, ``judge_error`` and ``judge_source``.
    """
    named = F.col(backend).isin(list(backends))
    out = warn.filter(~F.coalesce(named, F.lit(False))).withColumns({
        "judge_decision": F.lit(FAILURE_DECISION["stub"]), "judge_error": F.lit(None).cast("string"), "judge_source": F.lit("none")})
    for name, judged in backends.items():
        out = out.unionByName(judged(warn.filter(F.col(backend) == name)).select(*out.columns))
    return out
