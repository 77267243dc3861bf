"""What the operators share: words, folds, row keys and digests."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: The ASCII white space between words, as the inside of a character class.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
#: Rows that are sent to Python at once, at most.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this Python worker keeps between tasks, under its owner.
_kept: dict[tuple, object] = {}


def worker_keeps(owner: tuple, make: Callable[[], T]) -> T:
    """An object a worker keeps between tasks; keeping one lets go of all others, so caches never add up."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends at most ``BATCH_ROWS`` of them to Python at once.

    A batch of texts is held on both sides of the pipe, so its size sets the
    memory of a task. A session that asks for less keeps its own setting.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def text_or_empty(column: str | Column = "text") -> Column:
    """The text; a missing one reads as empty."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, in order."""
    return F.array_remove(F.split(text, rf"[{BLANKS}]+"), "")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; NULL keys read as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def sha256_hex(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def whole_row(df: DataFrame, name: str = "__row") -> DataFrame:
    """All columns packed into one, so that no name of theirs can clash with a new column."""
    return df.select(F.struct("*").alias(name))
