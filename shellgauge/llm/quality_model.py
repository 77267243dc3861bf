"""A quality score from random Fourier features.

A text is measured by a few statistics of its characters, words and lines. The
statistics are standardised and mapped through random cosines, whose inner
products approximate a Gaussian kernel. Ridge regression on these features needs
only sums of outer products: every partition of labelled rows sums its own, and
the parts are added by a grouped sum, one row for each line of the matrix. The
sums are kept by fold, so scores for the calibration come from models that did
not see the row. Isotonic regression over those scores, on a fixed grid, turns
the raw score into a calibrated one.

Labels are read only of rows outside the held-out fold; labels, languages,
sources and ids never enter a score. Statistics are computed once for all rows
and written without the texts. What reaches the driver is bounded by the number
of features and grid cells.

Null and empty texts have zero statistics and are scored like any other. Rows
with equal statistics have equal scores. Repeated labels count each; a document
without a key has no label. With no labels, or labels of one value only, all
scores are the share of good labels (one half where there is none). Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellgauge.llm.common import BLANKS, fold, in_small_batches, text_or_empty
from shellgauge.session import scratch

#: Random cosines, width of the kernel in standard deviations, and weight of the ridge for each row.
COSINES, WIDTH, RIDGE = 128, 4.0, 1e-3
SEED = 20_07
FOLDS, HELD_OUT = 4, 2
#: Cells of the calibration's grid, over raw scores from LOW to HIGH.
CELLS, LOW, HIGH = 400, -0.5, 1.5
#: Weight of the raw score itself in the result, so that ties of the isotonic steps keep their order.
SLOPE = 0.01
#: Partitions whose sums of outer products are added.
PARTS = 32
ACCEPT = 0.7

STATISTICS = [
    "log_chars", "log_words", "mean_word", "symbols", "upper", "digits", "punctuation", "ends", "other",
    "distinct", "adjacent", "top_word", "dup_lines", "words_per_line", "pipes", "entropy",
]
WORD = re.compile(rf"[^{BLANKS}]+")
#: Classes of bytes, by number: other, blank, lower, upper, digit, symbol, pipe, sentence end, punctuation.
_CLASS = np.full(256, 0, dtype=np.uint8)
for _name, _chars in enumerate(["\x20\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "|", ".!?", ",;:'\"()-"]):
    for _c in _chars:
        _CLASS[ord(_c)] = _name + 1
_TABLE = _CLASS.tobytes()


def measure(text: str) -> list[float]:
    """The statistics of one text."""
    words = WORD.findall(text)
    if not words:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    classes = raw.translate(_TABLE)
    n = [classes.count(bytes([k])) for k in range(9)]
    shown = max(1, len(raw) - n[1])
    count = len(words)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    own = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    counts = np.fromiter(tally.values(), dtype=np.float64, count=len(tally)) / count
    adjacent = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(raw)), np.log1p(count), shown / count, n[5] / shown, n[3] / shown, n[4] / shown, n[8] / shown,
        n[7] / count, n[0] / shown, len(tally) / count, adjacent / count, float(counts.max()),
        1 - len(set(own)) / max(1, len(own)), np.log1p(count / max(1, len(own))), n[6] / count,
        float(-(counts * np.log(counts)).sum()) / np.log(count + 1),
    ]


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``x``, the statistics of every row's whole text."""
    source = in_small_batches(docs).select(F.col(key).alias("key"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "x": [measure(t) for t in batch["t"]]})

    return source.mapInPandas(run, f"key {source.schema[0].dataType.simpleString()}, x array<double>")


@dataclass
class Model:
    """What a score needs: standardisation, cosines, weights and the calibration's grid."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    grid: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return features(x, self.mean, self.scale, self.frequencies, self.phases)

    def score(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.features(x) @ self.weights, self.grid)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """A constant, the standardised statistics clipped, and the random cosines of them."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(z), 1)), np.cos(z @ frequencies + phases) * np.sqrt(2 / len(phases))])


def calibrated(raw: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Isotonic value at the raw score, between grid centres on a line, with a slight slope over all."""
    centres = LOW + (np.arange(CELLS) + 0.5) * (HIGH - LOW) / CELLS
    slope = np.clip((raw - LOW) / (HIGH - LOW), 0, 1)
    return np.clip((1 - SLOPE) * np.interp(raw, centres, grid) + SLOPE * slope, 0, 1)


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over the cells that have rows; the others lie between their neighbours."""
    at = np.flatnonzero(counts)
    blocks: list[list[float]] = []
    for i in at:
        blocks.append([sums[i], counts[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    fitted = np.concatenate([np.full(int(b[2]), b[0] / b[1]) for b in blocks])
    return np.interp(np.arange(len(counts)), at, fitted)


def fit(known: DataFrame) -> Model | float:
    """Fit from rows of ``x``, ``y`` (0 or 1) and ``fold``; a constant where there is nothing to tell apart."""
    size = len(STATISTICS)
    moments = known.agg(
        F.count("*").alias("n"), F.avg("y").alias("share"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(size)],
    ).first()
    if not moments["n"] or moments["share"] in (0.0, 1.0):
        return 0.5 if moments["share"] is None else float(moments["share"])
    mean = np.array([moments[f"m{i}"] for i in range(size)])
    scale = np.array([max(moments[f"s{i}"], 1e-6) for i in range(size)])
    dice = np.random.default_rng(SEED)
    frequencies = dice.normal(0, 1 / WIDTH, (size, COSINES))
    phases = dice.uniform(0, 2 * np.pi, COSINES)
    mapped = lambda x: features(np.vstack(x), mean, scale, frequencies, phases)

    def outer_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, own in batch.groupby("fold"):
                z = np.hstack([mapped(own["x"]), own[["y"]].to_numpy(float)])
                sums[k] = sums.get(k, 0) + z.T @ z
        for k, total in sums.items():
            yield pd.DataFrame({"fold": k, "line": range(len(total)), "v": list(total)})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, v in batch.itertuples(index=False):
                total[k, i] = total.get((k, i), 0) + v
        yield pd.DataFrame([(k, i, v) for (k, i), v in total.items()], columns=["fold", "line", "v"])

    schema = "fold int, line int, v array<double>"
    lines = known.repartition(PARTS).mapInPandas(outer_sums, schema).repartition(8, "line").mapInPandas(added, schema).collect()
    width = COSINES + 2
    parts = {k: np.zeros((width, width)) for k in {r["fold"] for r in lines}}
    for r in lines:
        parts[r["fold"]][r["line"]] = r["v"]

    def solve(total: np.ndarray) -> np.ndarray:
        a, b = total[:-1, :-1], total[:-1, -1]
        return np.linalg.solve(a + RIDGE * max(total[0, 0], 1) * np.eye(len(a)), b)

    whole = sum(parts.values())
    without = {k: solve(whole - part) for k, part in parts.items()}

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, own in batch.groupby("fold"):
                raw = mapped(own["x"]) @ without[k]
                cell = np.clip(((raw - LOW) / (HIGH - LOW) * CELLS).astype(int), 0, CELLS - 1)
                yield pd.DataFrame({"cell": cell, "y": own["y"].to_numpy(float)})

    tallied = known.mapInPandas(cells, "cell int, y double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    counts, sums = np.zeros(CELLS), np.zeros(CELLS)
    for r in tallied:
        counts[r["cell"]], sums[r["cell"]] = r["n"], r["y"]
    return Model(mean, scale, frequencies, phases, solve(whole), isotonic(counts, sums))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key``, ``held_out`` and ``score`` of every row."""
    spark = docs.sparkSession
    at = scratch(spark, "quality")
    statistics(docs, key, text).write.parquet(at)
    measured = spark.read.parquet(at)
    part: Column = fold(F.col("key"), FOLDS).cast("int")
    wanted = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull())
    known_at = scratch(spark, "quality")
    measured.withColumn("fold", part).filter(F.col("fold") != HELD_OUT).join(wanted, "key").select("x", "y", "fold").write.parquet(known_at)
    model = fit(spark.read.parquet(known_at))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = np.full(len(batch), model) if isinstance(model, float) else (model.score(np.vstack(batch["x"])) if len(batch) else [])
            yield pd.DataFrame({"key": batch["key"], "held_out": batch["held_out"], "score": own})

    flagged = measured.withColumn("held_out", part == HELD_OUT).select("key", "held_out", "x")
    scored = flagged.mapInPandas(run, f"key {measured.schema['key'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumnRenamed("key", key)
