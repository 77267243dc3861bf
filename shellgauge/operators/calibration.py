"""Probability calibration per axis: alignment, fits as iterated aggregates, metrics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from shellgauge.functions.numeric import EPS, clamp, is_finite, logit, platt, sigmoid, temper
from shellgauge.functions.text import let, literal
from shellgauge.operators.context import positions
from shellgauge.session import checkpoint, small

# Defaults of a fit.
HOLDOUT = 0.25
SEED = 42
MIN_PAIRS = 10
BETA_RANGE = (0.02, 50.0)
# A step this short no longer changes a reported parameter.
SETTLED = 1e-9
# Shares of the curvature that the trial points of a round add to it.
DAMPING = (0.0, 1e-2, 1.0)
# A relative fall of the loss below this is rounding.
GAIN = 1e-13


def align_pairs(reference: DataFrame, target: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (item, axis) answered on both sides with the same kind.

    Inputs: ``item_id, answers``. Items are joined once, whole, and answers are
    matched on the row, so the shuffle carries items instead of answers.
    ``extra`` columns of the reference stay.
    """
    return align_rows(reference.select("item_id", *extra, F.col("answers").alias("reference")).join(
        target.select("item_id", F.col("answers").alias("target")), "item_id"), extra)


def align_rows(both: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The same where both sides stand on one row, as ``item_id, reference, target``: no join.

    Vectors follow the reference's label order; a label the target lacks
    counts 0. A noul pair is a vector of one.
    """
    def pair(r: Column, t: Column) -> Column:
        def aligned(label: Column) -> Column:
            at = F.array_position(t["labels"], label)
            return F.when(at > 0, F.try_element_at(t["probs"], at.cast("int"))).otherwise(F.lit(0.0))

        scalar = r["type"] == "noul"
        filled = lambda xs: F.coalesce(F.size(xs), F.lit(0)) > 0
        usable = F.when(scalar, is_finite(t["noul"]) & is_finite(r["noul"])).otherwise(
            filled(r["labels"]) & filled(t["labels"]))
        return F.when((r["type"] == t["type"]) & usable, F.struct(
            r["axis"].alias("axis"), r["type"].alias("type"),
            F.when(scalar, F.array(t["noul"])).otherwise(F.transform(r["labels"], aligned)).alias("p"),
            F.when(scalar, F.array(r["noul"])).otherwise(r["probs"]).alias("q")))

    def match(sides: Column) -> Column:
        # bound once per answer: every label of it reads the target again
        return F.transform(sides["r"], lambda r: let(F.try_element_at(sides["t"], r["axis"]), lambda t: pair(r, t)))

    # A repeated axis counts once, the first time.
    names = F.transform("target", lambda w: w["axis"])
    once = let(names, lambda ns: F.filter("target", lambda w, i: F.array_position(ns, w["axis"]) == i + 1))
    sides = F.struct(F.col("reference").alias("r"), F.map_from_entries(F.transform(
        once, lambda w: F.struct(w["axis"], w))).alias("t"))
    pairs = both.select("item_id", *extra, F.explode_outer(let(sides, match)).alias("z"))
    return pairs.filter("z is not null").select("item_id", *extra, "z.axis", "z.type", "z.p", "z.q")


def target_models(items: DataFrame) -> DataFrame:
    """Distinct target models and whether one can be pinned."""
    return items.filter(F.col("target_model") != "").agg(
        F.array_sort(F.collect_set("target_model")).alias("models")).select(
        "models", F.when(F.size("models") == 1, F.element_at("models", 1)).alias("pinned"),
        F.when(F.size("models") == 0, F.lit("the pairs carry no target model"))
        .when(F.size("models") > 1, F.lit("pairs come from several target models")).alias("error"))


def holdout_split(items: DataFrame, item_id: str = "item_id", holdout: float = HOLDOUT,
                  seed: int = SEED) -> DataFrame:
    """Exactly ``round(n * holdout)`` items become the test set, by hash rank.

    Ranks come from 4,096 hash buckets, so neither the ranking nor the count
    puts the items into one task.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item_id).cast("string")), 256)
    hashed = items.withColumn("__key", key)
    ranked = positions(hashed, [], ["__key", item_id], F.substring("__key", 1, 3), "__rank", "__total")
    n_test = F.floor(F.col("__total") * holdout + 0.5)
    return ranked.withColumn("split", F.when(F.col("__rank") <= n_test, F.lit("test")).otherwise(
        F.lit("train"))).drop("__key", "__rank", "__total")


def _weight(pairs: DataFrame) -> Column:
    """How often a pair counts: ``w`` where equal pairs are one row, else once."""
    return F.col("w") if "w" in pairs.columns else F.lit(1.0)


def _weighted(pairs: DataFrame, *extra: str) -> DataFrame:
    """Equal pairs counted once: the fits read this table once per round."""
    return checkpoint(pairs.groupBy("axis", "type", "p", "q", *extra).agg(F.sum(_weight(pairs)).alias("w")))


def _at(values: dict, axis: Column, kind: str) -> Column:
    return F.element_at(literal(values, f"map<string,{kind}>"), axis)


def fit_platt(pairs: DataFrame, rounds: int = 60) -> list[dict]:
    """Slope and intercept of every noul axis on soft targets.

    Each round is one grouped aggregate that tries several points for every axis
    at once: the same second-order model, damped from not at all to strongly.
    The best point becomes the next centre; an axis is settled when no damping
    lowers its loss any more. ``converged`` is false for axes still moving after
    the last round. The driver only sees one row per axis of the rubric.
    """
    w = _weighted(pairs.filter(F.col("type") == "noul")).select(
        "axis", logit(F.col("p")[0]).alias("x"), F.col("q")[0].alias("q"), "w")
    axis, x, q, wt = F.col("axis"), F.col("x"), F.col("q"), F.col("w")
    sizes = {r.axis: int(r.n) for r in w.groupBy("axis").agg(F.sum("w").alias("n")).collect()}
    trial = {k: [(1.0, 0.0)] * len(DAMPING) for k in sizes}
    best: dict[str, tuple[float, float, float]] = {}
    live = set(sizes)
    for _ in range(rounds):
        if not live:
            break
        at = _at({k: [{"a": a, "b": b} for a, b in trial[k]] for k in live}, axis, "array<struct<a:double,b:double>>")
        sums = []
        for j in range(len(DAMPING)):
            s = sigmoid(at[j]["a"] * x + at[j]["b"])
            kept, curve = clamp(s, 1e-15, 1 - 1e-15), s * (1 - s)
            terms = {"loss": -(q * F.log(kept) + (1 - q) * F.log(1 - kept)), "ga": (s - q) * x, "gb": s - q,
                     "haa": curve * x * x, "hab": curve * x, "hbb": curve}
            sums.append(F.struct(*[F.sum(wt * t).alias(n) for n, t in terms.items()]).alias(f"t{j}"))
        for r in w.filter(axis.isin(sorted(live))).groupBy("axis").agg(*sums).collect():
            k = r.axis
            tried = [(t.loss, j, t) for j in range(len(DAMPING)) if math.isfinite((t := r[f"t{j}"]).loss)]
            loss, j, t = min(tried, key=lambda o: o[:2]) if tried else (math.inf, 0, None)
            if t is None or (k in best and loss > best[k][0] - GAIN * (1 + abs(loss))):
                live.discard(k)
                continue
            best[k] = (loss, *trial[k][j])
            trial[k] = [_damped(best[k][1:], t, d) for d in DAMPING]
    return [{"axis": k, "type": "noul", "method": "platt", "a": best[k][1], "b": best[k][2], "n": sizes[k], "converged": k not in live}
            if k in best else {"axis": k, "type": "noul", "method": "platt", "a": 1.0, "b": 0.0, "n": sizes[k], "converged": False}
            for k in sorted(sizes)]


def _damped(centre: tuple[float, float], sums: Row, damping: float) -> tuple[float, float]:
    """Where the quadratic model has its least value when the curvature is raised by a share of its trace."""
    ridge = damping * (sums.haa + sums.hbb) + 1e-12
    curvature = np.array([[sums.haa + ridge, sums.hab], [sums.hab, sums.hbb + ridge]])
    step = np.linalg.lstsq(curvature, np.array([sums.ga, sums.gb]), rcond=None)[0]
    return float(centre[0] - step[0]), float(centre[1] - step[1])


def fit_temperature(pairs: DataFrame, rounds: int = 100) -> list[dict]:
    """Temperature of every choice or score axis: where the slope of the loss in 1/t is zero.

    One grouped aggregate per round gives slope and curvature of all axes; a
    Newton step that leaves the bracket becomes a bisection.
    """
    w = _weighted(pairs.filter(F.col("type") != "noul"))
    kinds = {r.axis: (r.type, int(r.n)) for r in w.groupBy("axis").agg(
        F.first("type").alias("type"), F.sum("w").alias("n")).collect()}
    bracket = dict.fromkeys(kinds, BETA_RANGE)
    beta = dict.fromkeys(kinds, 1.0)
    live = set(kinds)
    logs = F.transform("p", lambda v: F.log(F.greatest(v, F.lit(EPS))))
    dot = lambda xs, ys: F.aggregate(
        F.arrays_zip(xs.alias("x"), ys.alias("y")), F.lit(0.0), lambda acc, z: acc + z["x"] * z["y"])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)
    logged = w.withColumn("l", logs).withColumn("l2", F.transform("l", lambda v: v * v))
    for _ in range(rounds):
        if not live:
            break
        now = logged.filter(F.col("axis").isin(sorted(live))).withColumn(
            "s", temper(F.col("p"), 1.0 / _at(beta, F.col("axis"), "double")))
        # Probabilities at the floor no longer move the loss.
        seen = now.withColumn("m", F.zip_with("q", "s", lambda q, s: F.when(s >= EPS, q).otherwise(F.lit(0.0))))
        mean, mass = dot(F.col("s"), F.col("l")), total(F.col("m"))
        rows = seen.groupBy("axis").agg(
            F.sum(F.col("w") * (mass * mean - dot(F.col("m"), F.col("l")))).alias("slope"),
            F.sum(F.col("w") * mass * (dot(F.col("s"), F.col("l2")) - mean * mean)).alias("curve")).collect()
        for r in rows:
            k, (lo, hi) = r.axis, bracket[r.axis]
            lo, hi = (lo, beta[k]) if r.slope > 0 else (beta[k], hi)
            bracket[k] = (lo, hi)
            nxt = beta[k] - r.slope / r.curve if r.curve > 0 else lo - 1
            nxt = nxt if lo < nxt < hi else (lo + hi) / 2
            if abs(nxt - beta[k]) < SETTLED or hi - lo < SETTLED:
                live.discard(k)
            beta[k] = nxt
    return [{"axis": k, "type": kinds[k][0], "method": "temperature", "t": 1.0 / beta[k], "n": kinds[k][1]}
            for k in sorted(beta)]


def calibrated(pairs: DataFrame, params: list[dict]) -> DataFrame:
    """Add ``p_after``: the target vector under the axis parameters."""
    from shellgauge.operators.answers import params_column

    par = F.try_element_at(params_column(params), F.col("axis"))
    return pairs.withColumn("p_after", F.when(par.isNull(), F.col("p")).when(
        par["method"] == "platt", F.transform("p", lambda p: platt(p, par["a"], par["b"]))).otherwise(
        temper(F.col("p"), par["t"])))


def brier(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Per axis: mean over items of the squared error summed over labels."""
    err = F.aggregate(F.arrays_zip(F.col(p).alias("p"), F.col("q").alias("q")), F.lit(0.0),
                      lambda acc, z: acc + (z["p"] - z["q"]) * (z["p"] - z["q"]))
    return pairs.groupBy("axis").agg((F.sum(_weight(pairs) * err) / F.sum(_weight(pairs))).alias("brier"))


def ece(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Per axis: expected calibration error over 10 equal-width bins."""
    flat = pairs.select("axis", _weight(pairs).alias("w"), F.explode_outer(
        F.arrays_zip(F.col(p).alias("p"), F.col("q").alias("q"))).alias("z")).filter("z is not null")
    bins = flat.select("axis", "w", F.col("z.p").alias("p"), F.col("z.q").alias("q"),
                       F.least(F.floor(F.col("z.p") * 10), F.lit(9)).alias("bin"))
    per_bin = bins.groupBy("axis", "bin").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("p")).alias("sp"), F.sum(F.col("w") * F.col("q")).alias("sq"))
    return per_bin.groupBy("axis").agg((F.sum(F.abs(F.col("sp") - F.col("sq"))) / F.sum("n")).alias("ece"))


def fit_report(pairs: DataFrame, min_pairs: int = MIN_PAIRS) -> tuple[list[dict], DataFrame]:
    """Fit on the train split, measure on the test split; axes with too few pairs are skipped.

    Fits and measures read the distinct pairs of each split with their counts, stored once.
    """
    pairs = _weighted(pairs, "split")
    train = pairs.filter(F.col("split") == "train")
    among = lambda split: F.coalesce(F.sum(F.when(F.col("split") == split, F.col("w"))), F.lit(0.0)).cast("bigint")
    counts = pairs.groupBy("axis", "type").agg(among("train").alias("n_train"), among("test").alias("n_test"))
    enough = small(counts.filter(F.col("n_train") >= min_pairs).select("axis"))
    usable = train.join(enough, "axis", "left_semi")
    params = fit_platt(usable) + fit_temperature(usable)
    test = calibrated(pairs.filter(F.col("split") == "test"), params)
    out = counts
    for name, frame in (
        ("brier_before", brier(test).withColumnRenamed("brier", "brier_before")),
        ("brier_after", brier(test, "p_after").withColumnRenamed("brier", "brier_after")),
        ("ece_before", ece(test).withColumnRenamed("ece", "ece_before")),
        ("ece_after", ece(test, "p_after").withColumnRenamed("ece", "ece_after")),
    ):
        out = out.join(frame.select("axis", name), "axis", "left")
    by_axis = {p["axis"]: {k: p.get(k) for k in ("method", "a", "b", "t")} for p in params}
    par = F.try_element_at(literal(by_axis, "map<string,struct<method:string,a:double,b:double,t:double>>"), F.col("axis"))
    return params, out.withColumn("__par", par).select(
        "axis", "type", "n_train", "n_test", "__par.method", "__par.a", "__par.b", "__par.t",
        *[F.when(F.col("n_train") >= min_pairs, F.col(c)).alias(c)
          for c in ("brier_before", "brier_after", "ece_before", "ece_after")],
        F.when(F.col("n_train") < min_pairs, F.concat(
            F.col("n_train").cast("string"), F.lit(f" fitting pairs (< {min_pairs})"))).alias("skipped"))


def validate_params(params: DataFrame, axes: DataFrame) -> DataFrame:
    """Structural problems of a parameter table against a rubric; empty when it is sound."""
    dim = small(axes.select(F.col("id").alias("axis"), "primitive"))
    j = params.join(dim, "axis", "left")
    wants = F.when(F.col("primitive") == "noul", F.lit("platt")).otherwise(F.lit("temperature"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    problem = (
        F.when(F.col("primitive").isNull(), F.lit("axis is not in the rubric"))
        .when(F.col("type") != F.col("primitive"), F.lit("type differs from the rubric"))
        .when(F.col("method") != wants, F.lit("method does not apply"))
        .when((F.col("method") == "platt") & (bad("a") | bad("b")), F.lit("a and b must be finite"))
        .when((F.col("method") == "temperature") & (bad("t") | (F.col("t") <= 0)), F.lit("t must be finite and > 0")))
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("axis", "problem")


def pin_check(answers: DataFrame, rubric_hash: str, model: str) -> DataFrame:
    """Error per item whose rubric or model is not the pinned one, or not named; null when it may be calibrated."""
    return answers.withColumn("pin_error", F.when(
        ~F.col("rubric_hash").eqNullSafe(F.lit(rubric_hash)), F.lit("pinned to another rubric")).when(
        ~F.col("model").eqNullSafe(F.lit(model)), F.lit("pinned to another model")))


def temper_rows(rows: DataFrame, t: Column) -> DataFrame:
    """Temperature transform of long rows ``item_id, axis, label, p``."""
    whole = Window.partitionBy("item_id", "axis")
    scaled = rows.withColumn("__l", F.log(F.greatest(F.col("p"), F.lit(EPS))) / t)
    e = F.exp(F.col("__l") - F.max("__l").over(whole))
    return scaled.withColumn("__e", e).withColumn(
        "p_tempered", F.col("__e") / F.sum("__e").over(whole)).drop("__l", "__e")
