"""Masked per-category metrics, average precision, threshold tuning and losses, on long rows.

Rows: contract, chunk_id, category, category_idx, label (0/1), mask (false: unknown), score
[, fold]. All figures come from counts per (category, score), so one partial aggregation
shrinks the rows before anything is sorted; ratios are single divisions of integers, and
sums of ratios are taken in fixed point, so results do not depend on the order of rows.
Undefined figures are null, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.operators.checks import check_grid, require_empty, threshold_values
from lexspan.schema import CATEGORIES, FINE_GRID, LOW_SUPPORT, THRESHOLD, TUNING_GRID, UNSTABLE_STD
from lexspan.session import forget, spill

SCALE = 10**12
#: Stretches of score that are summed by themselves first, so that no task sorts a whole category.
STRETCHES = 1000


def fixed(value: Column) -> Column:
    return F.floor(value * F.lit(float(SCALE))).cast("long")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def threshold_column(thresholds, categories: Iterable[str] = CATEGORIES) -> Column:
    """A category's threshold (validated) as an expression."""
    values = threshold_values(thresholds, categories)
    return reduce(lambda acc, c: acc.when(F.col("category") == c, F.lit(values[c])), values, F.when(F.lit(False), F.lit(0.0)))


def decisions(rows: DataFrame, thresholds=THRESHOLD, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """Adds ``decision``: 1 where the score is the threshold or more."""
    return rows.withColumn("decision", (F.col("score") >= threshold_column(thresholds, categories)).cast("int"))


def stored_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows, masked ones too, counted by keys, category, score and mask: ``n`` rows, ``tp`` of them positive. Stored.

    Everything below can be had from these counts, so what made the rows runs once.
    """
    return spill(rows.sparkSession, rows.groupBy(*keys, "category", "score", "mask").agg(F.count("*").alias("n"), F.sum("label").alias("tp")))[0]


def score_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Unmasked rows counted by key, category and score: ``n`` rows, ``tp`` of them positive."""
    return rows.where("mask").groupBy(*keys, "category", "score").agg(F.count("*").alias("n"), F.sum("label").alias("tp"))


def _unmasked(counts: DataFrame, *keys: str) -> DataFrame:
    """``score_counts`` from ``stored_counts``."""
    return counts.where("mask").groupBy(*keys, "category", "score").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))


def cumulative(counts: DataFrame, *keys: str) -> DataFrame:
    """``score_counts`` with ``cum_n`` and ``cum_tp``: rows and positives of that score or higher."""
    by = [*keys, "category"]
    cut = counts.withColumn("stretch", F.floor(F.col("score") * STRETCHES))
    above = cut.groupBy(*by, "stretch").agg(F.sum("n").alias("sn"), F.sum("tp").alias("st"))
    before = Window.partitionBy(*by).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    above = above.select(*by, "stretch", F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("above_n"), F.coalesce(F.sum("st").over(before), F.lit(0)).alias("above_tp"))
    within = Window.partitionBy(*by, "stretch").orderBy(F.desc("score"))
    own = cut.withColumn("cum_n", F.sum("n").over(within)).withColumn("cum_tp", F.sum("tp").over(within))
    return own.join(above, [*by, "stretch"]).withColumn("cum_n", F.col("cum_n") + F.col("above_n")).withColumn("cum_tp", F.col("cum_tp") + F.col("above_tp")).drop("stretch", "above_n", "above_tp")


def average_precision(rows: DataFrame, *keys: str) -> DataFrame:
    """Per category: the sum over distinct scores of recall gained times precision there; null without positives."""
    return _precision_of(score_counts(rows, *keys), *keys)


def precision_counted(counts: DataFrame, *keys: str) -> DataFrame:
    """``average_precision`` from ``stored_counts``."""
    return _precision_of(_unmasked(counts, *keys), *keys)


def _precision_of(counts: DataFrame, *keys: str) -> DataFrame:
    curve = cumulative(counts, *keys)
    at = F.col("tp") * fixed(F.col("cum_tp") / F.col("cum_n"))
    found = curve.groupBy(*keys, "category").agg(F.sum(at).alias("s"), F.sum("tp").alias("p"))
    return found.select(*keys, "category", F.when(F.col("p") > 0, F.col("s") / (F.col("p") * F.lit(SCALE).cast("long"))).alias("average_precision"))


def pr_curve(rows: DataFrame, *keys: str) -> DataFrame:
    """Recall and precision at every distinct score, and the end point (recall 0, precision 1)."""
    curve = cumulative(score_counts(rows, *keys), *keys)
    total = curve.groupBy(*keys, "category").agg(F.sum("tp").alias("p")).where("p > 0")
    points = curve.join(total, [*keys, "category"]).select(*keys, "category", (F.col("cum_tp") / F.col("p")).alias("recall"), (F.col("cum_tp") / F.col("cum_n")).alias("precision"))
    return points.unionByName(total.select(*keys, "category", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))).distinct()


def _rates(tp: str, predicted: str, support: str, scored: str) -> list[Column]:
    t, p, s = F.col(tp), F.col(predicted), F.col(support)
    some = F.col(scored) > 0
    return [F.when(some, ratio(t, p)).alias("precision"), F.when(some, ratio(t, s)).alias("recall"), F.when(some, ratio(2 * t, p + s)).alias("f1")]


def score_counted(decided: DataFrame, threshold: Column, *keys: str) -> DataFrame:
    """Category, macro and micro rows from ``stored_counts`` with ``decision``; ``threshold`` is an expression on category rows."""
    valid, hit = F.col("mask"), F.col("decision") == 1
    total = lambda c, n="n": F.coalesce(F.sum(F.when(c, F.col(n)).otherwise(0)), F.lit(0))
    sums = decided.groupBy(*keys, "category").agg(
        total(valid, "tp").alias("support"), total(valid).alias("scored_chunks"), total(~valid).alias("masked_chunks"),
        total(valid & hit).alias("predicted_positive"), total(valid & hit, "tp").alias("tp"),
    )
    counts = ["support", "scored_chunks", "masked_chunks", "predicted_positive"]
    rows = sums.select(*keys, "category", threshold.alias("threshold"), *counts, *_rates("tp", "predicted_positive", "support", "scored_chunks"), "tp")
    rows = rows.join(_precision_of(_unmasked(decided, *keys), *keys), [*keys, "category"], "left")
    one_threshold = F.when((F.min("threshold") == F.max("threshold")) & (F.count("threshold") == F.count("*")), F.min("threshold")).alias("threshold")
    totals = [F.sum(c).alias(c) for c in counts]
    mean = lambda c: (F.sum(fixed(F.col(c))) / (F.count(c) * F.lit(SCALE).cast("long"))).alias(c)
    grouped = rows.groupBy(*keys)
    macro = grouped.agg(F.lit("macro avg").alias("category"), one_threshold, *totals, *(mean(c) for c in ("precision", "recall", "f1", "average_precision")))
    pooled = grouped.agg(F.lit("micro avg").alias("category"), one_threshold, *totals, F.sum("tp").alias("tp"))
    micro = pooled.select(*keys, "category", "threshold", *counts, *_rates("tp", "predicted_positive", "support", "scored_chunks"), F.lit(None).cast("double").alias("average_precision"))
    return rows.drop("tp").unionByName(macro).unionByName(micro)


def score(rows: DataFrame, thresholds=THRESHOLD, *keys: str, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """Precision, recall, F1 and average precision of each category, their mean (macro) and pooled (micro)."""
    return score_counted(decisions(stored_counts(rows, *keys), thresholds, categories), threshold_column(thresholds, categories), *keys)


def score_given(decided: DataFrame, *keys: str) -> DataFrame:
    """``score`` of decisions made elsewhere (column ``decision``); thresholds are null."""
    counts = stored_counts(decided, *keys, "decision")
    return score_counted(counts, F.lit(None).cast("double"), *keys)


# Tuning ---------------------------------------------------------------------


def _grid_counts(counts: DataFrame, grid: tuple[float, ...], *keys: str) -> DataFrame:
    """Per key, category and grid step: rows and positives whose score reaches exactly that many steps."""
    steps = F.array(*(F.lit(g) for g in grid))
    reached = counts.withColumn("step", F.size(F.filter(steps, lambda t: F.col("score") >= t)))
    return reached.groupBy(*keys, "category", "step").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))


def _best(histogram: DataFrame, at_default: DataFrame, grid: tuple[float, ...], default: float, *keys: str) -> DataFrame:
    by = [*keys, "category"]
    totals = histogram.groupBy(*by).agg(F.sum("tp").alias("support"))
    places = totals.select(*by, F.posexplode(F.array(*(F.lit(g) for g in grid))).alias("i", "threshold")).withColumn("step", F.col("i") + 1)
    filled = places.join(histogram, [*by, "step"], "left")
    down = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per grid step
    at = filled.select(*by, "threshold", F.sum(F.coalesce("tp", F.lit(0))).over(down).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(down).alias("pp")).join(totals, by)
    f1 = ratio(2 * F.col("tp"), F.col("pp") + F.col("support"))
    order = Window.partitionBy(*by).orderBy(F.desc("f1"), "threshold")
    best = at.withColumn("f1", f1).withColumn("place", F.row_number().over(order)).where("place = 1").join(at_default, by)
    some = F.col("support") > 0
    given = lambda c: F.when(some, c)
    default_f1 = ratio(2 * F.col("d_tp"), F.col("d_pp") + F.col("support"))
    return best.select(
        *by, F.when(some, F.col("threshold")).otherwise(F.lit(default)).alias("threshold"), "support", given(F.col("f1")).alias("f1"), given(ratio(F.col("tp"), F.col("pp"))).alias("precision"), given(ratio(F.col("tp"), F.col("support"))).alias("recall"),
        F.lit(default).alias("default_threshold"), given(default_f1).alias("default_f1"), given(F.col("f1") - default_f1).alias("f1_gain"),
    )


def tune_thresholds(rows: DataFrame, grid: Iterable[float] = TUNING_GRID, default: float = THRESHOLD, *keys: str) -> DataFrame:
    """Per category the grid threshold of best F1 (the lowest of equals) and its gain; the default without positives.

    A category without unmasked rows is not listed.
    """
    return _tuned(stored_counts(rows, *keys), check_grid(grid), default, *keys)


def _at_default(counts: DataFrame, default: float, *keys: str) -> DataFrame:
    high = F.col("score") >= default
    return counts.groupBy(*keys, "category").agg(F.sum(F.when(high, F.col("tp")).otherwise(0)).alias("d_tp"), F.sum(F.when(high, F.col("n")).otherwise(0)).alias("d_pp"))


def _tuned(counts: DataFrame, steps: tuple[float, ...], default: float, *keys: str) -> DataFrame:
    own = _unmasked(counts, *keys)
    return _best(_grid_counts(own, steps, *keys), _at_default(own, default, *keys), steps, default, *keys)


def threshold_map(tuned: DataFrame) -> dict[str, float]:
    """A tuning result as category -> threshold (a row per category)."""
    return {r["category"]: r["threshold"] for r in tuned.select("category", "threshold").collect()}


def cross_fit_thresholds(rows: DataFrame, grid: Iterable[float] = FINE_GRID, default: float = THRESHOLD) -> DataFrame:
    """Per held-out fold and category, the threshold tuned on all other folds: total counts less the fold's own, in one pass."""
    return _cross_fitted(stored_counts(rows, "fold"), check_grid(grid), default)


def _cross_fitted(counts: DataFrame, steps: tuple[float, ...], default: float, *keys: str) -> DataFrame:
    folds = F.broadcast(counts.select(*keys, F.col("fold").alias("held")).distinct())  # folds x keys
    own = _unmasked(counts, *keys, "fold")
    met = lambda frame: frame.join(folds, list(keys)) if keys else frame.crossJoin(folds)  # noqa: E731  folds x grid steps
    others = lambda frame, *by, **sums: met(frame).where("fold <> held").groupBy(*keys, "held", *by).agg(*(F.sum(c).alias(c) for c in sums))
    histogram = others(_grid_counts(own, steps, *keys, "fold"), "category", "step", n=1, tp=1)
    at_default = others(_at_default(own, default, *keys, "fold"), "category", d_tp=1, d_pp=1)
    return _best(histogram, at_default, steps, default, *keys, "held").withColumnRenamed("held", "fold")


def cross_fit_counted(counts: DataFrame, grid: Iterable[float] = FINE_GRID, *keys: str) -> DataFrame:
    """keys, fold, category, threshold: cross-fitted thresholds from ``stored_counts`` by keys and fold. At least two folds are needed."""
    require_empty(counts.agg(F.countDistinct("fold").alias("n")).where("n < 2"), "cross-fitting needs two folds")
    return _cross_fitted(counts, check_grid(grid), THRESHOLD, *keys).select(*keys, "fold", "category", "threshold")


def decided_by(rows: DataFrame, thresholds: DataFrame, *keys: str) -> DataFrame:
    """Rows, or counts of rows, with ``decision`` by a table of thresholds (keys, category, threshold); rows without one are left out."""
    told = F.broadcast(thresholds.select(*keys, "category", F.col("threshold").alias("_t")))  # folds x categories
    return rows.join(told, [*keys, "category"]).withColumn("decision", (F.col("score") >= F.col("_t")).cast("int")).drop("_t")


def tune_counted(counts: DataFrame, grid: Iterable[float] = TUNING_GRID, default: float = THRESHOLD, *keys: str) -> DataFrame:
    """``tune_thresholds`` from ``stored_counts``."""
    return _tuned(counts, check_grid(grid), default, *keys)


def cross_fit_decisions(rows: DataFrame, grid: Iterable[float] = FINE_GRID) -> DataFrame:
    """Adds ``decision`` by each row's fold's cross-fitted threshold. At least two folds are needed."""
    return decided_by(rows, cross_fit_counted(stored_counts(rows, "fold"), grid), "fold")


def final_thresholds(rows: DataFrame, grid: Iterable[float] = TUNING_GRID) -> DataFrame:
    """Thresholds from all rows, the spread of those that leave a fold out, and a flag for shaky ones."""
    counts, steps = stored_counts(rows, "fold"), check_grid(grid)
    spread = _cross_fitted(counts, steps, THRESHOLD).groupBy("category").agg(F.min("threshold").alias("fold_threshold_min"), F.max("threshold").alias("fold_threshold_max"), F.stddev_samp("threshold").alias("fold_threshold_std"))
    out = _tuned(counts, steps, THRESHOLD).join(spread, "category")
    flag = F.concat_ws("; ", F.when(F.col("fold_threshold_std") > UNSTABLE_STD, "unstable threshold"), F.when(F.col("support") < LOW_SUPPORT, "low support"))
    return out.withColumn("flag", flag)


def sweep_table(rows: DataFrame, config: str = "config") -> DataFrame:
    """Cross-fitted scores of several configurations at once, one macro row each: ``config``, macro_f1, micro_f1."""
    parts = []
    for c in sorted(r[0] for r in rows.select(config).distinct().collect()):  # a handful of configurations
        decided = cross_fit_decisions(rows.where(F.col(config) == c))
        parts.append(score_given(decided).withColumn(config, F.lit(c)))
    table = reduce(DataFrame.unionByName, parts)
    return table.groupBy(config).agg(F.max(F.when(F.col("category") == "macro avg", F.col("f1"))).alias("macro_f1"), F.max(F.when(F.col("category") == "micro avg", F.col("f1"))).alias("micro_f1"), F.max(F.when(F.col("category") == "macro avg", F.col("average_precision"))).alias("macro_ap"))


def positive_weights(rows: DataFrame) -> DataFrame:
    """Negatives over positives per category among unmasked rows; fails on a category without positives."""
    counts = rows.where("mask").groupBy("category").agg(F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives"))
    require_empty(counts.where("positives = 0"), "no positive rows")
    return counts.select("category", "positives", "negatives", (F.col("negatives") / F.col("positives")).alias("weight"))


# Losses ---------------------------------------------------------------------


def _bce(logit: Column, label: Column, weight: Column) -> Column:
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return (1 - label) * logit + (1 + (weight - 1) * label) * soft


def masked_bce(rows: DataFrame, weights: Mapping[str, float] | None = None, *keys: str) -> DataFrame:
    """Mean binary cross-entropy of ``logit`` over unmasked rows; 0 without any. Masked logits may be anything."""
    weight = reduce(lambda acc, w: acc.when(F.col("category") == w[0], F.lit(float(w[1]))), (weights or {}).items(), F.when(F.lit(False), F.lit(1.0))).otherwise(F.lit(1.0))
    valid = rows.where("mask").withColumn("loss", _bce(F.col("logit"), F.col("label"), weight))
    return _mean_loss(rows, valid, *keys)


def masked_focal(rows: DataFrame, gamma: float = 2.0, alpha: float = 0.25, *keys: str) -> DataFrame:
    """Mean focal loss over unmasked rows; 0 without any."""
    if gamma < 0 or not 0 <= alpha <= 1:
        raise ValueError("gamma must not be negative, alpha must lie in 0 to 1")
    bce = _bce(F.col("logit"), F.col("label"), F.lit(1.0))
    side = F.when(F.col("label") == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    valid = rows.where("mask").withColumn("bce", bce).withColumn("loss", side * F.pow(1 - F.exp(-F.col("bce")), F.lit(gamma)) * F.col("bce"))
    return _mean_loss(rows, valid, *keys)


def _mean_loss(rows: DataFrame, valid: DataFrame, *keys: str) -> DataFrame:
    if not keys:
        return valid.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))
    return rows.select(*keys).distinct().join(valid.groupBy(*keys).agg(F.avg("loss").alias("loss")), list(keys), "left").fillna(0.0, ["loss"])


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def weighted_mean_loss(batches: DataFrame) -> DataFrame:
    """Mean of batch losses (``loss``) weighted by their unmasked entries (``valid``)."""
    return batches.agg((F.sum(F.col("loss") * F.col("valid")) / F.sum("valid")).alias("loss"))


# Contract level -------------------------------------------------------------


def pool_contracts(rows: DataFrame) -> DataFrame:
    """The highest score of a category in a contract, and whether any window is positive; fails on scores outside 0 to 1.

    Stored, with the check of the scores made on what is stored, so what made the rows runs once.
    """
    wrong = F.max(F.expr("score is null or isnan(score) or score < 0 or score > 1")).alias("_wrong")
    pooled, path = spill(rows.sparkSession, rows.groupBy("contract", "category", "category_idx").agg(F.max("score").alias("score"), F.max("label").alias("label"), F.lit(True).alias("mask"), wrong))
    try:
        require_empty(pooled.where("_wrong").select("contract", "category", "score"), "scores must lie in 0 to 1")
    except ValueError:
        forget(rows.sparkSession, path)
        raise
    return pooled.drop("_wrong")


def require_same_contracts(a: DataFrame, b: DataFrame) -> None:
    x, y = (f.select("contract").distinct().withColumn(n, F.lit(True)) for f, n in ((a, "_a"), (b, "_b")))
    require_empty(x.join(y, "contract", "full").where("_a is null or _b is null").select("contract"), "contracts differ")
