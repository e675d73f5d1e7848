"""Score matrices: rows by place instead of by id, a column for each category.

Outside scorers return arrays in the order of the rows that they were given. Rows get dense
places (``operators.index``), a matrix is joined to them by place, and nothing is joined
before the matrix is known to have a row for each place, of the right width, with
probabilities only.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.operators.checks import require_columns, require_empty, threshold_values
from lexspan.operators.metrics import SCALE, fixed, pool_contracts, sigmoid
from lexspan.schema import CATEGORIES


def _width(categories: Iterable[str]) -> tuple[Column, int]:
    names = list(categories)
    return F.array(*(F.lit(c) for c in names)), len(names)


def _no_probability(scores: str) -> Column:
    return F.exists(scores, lambda s: s.isNull() | F.isnan(s) | (s < 0) | (s > 1))


def matrix_violations(rows: DataFrame, matrix: DataFrame, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """``check, key`` for every way in which ``matrix`` (row, scores) is not that of ``rows`` (row, chunk_id).

    missing, surplus and repeated places, rows of another width, values that are no
    probability; and, if the matrix repeats the ``chunk_id``, rows that were moved. Both may be
    of any size: one join on the place.
    """
    _, width = _width(categories)
    echo = F.first("chunk_id").alias("_echo") if "chunk_id" in matrix.columns else F.lit(None).cast("string").alias("_echo")
    wrong = F.array_compact(F.array(F.when(F.col("scores").isNull() | (F.size("scores") != width), F.lit("width")), F.when(_no_probability("scores"), F.lit("value"))))
    given = matrix.groupBy("row").agg(F.count("*").alias("_n"), F.flatten(F.collect_set(wrong)).alias("_wrong"), echo)
    both = rows.select("row", "chunk_id", F.lit(True).alias("_here")).join(given, "row", "full")
    checks = F.array_compact(F.array(
        F.when(F.col("_n").isNull(), F.lit("missing")), F.when(F.col("_here").isNull(), F.lit("surplus")), F.when(F.col("_n") > 1, F.lit("repeated")),
        F.when(F.col("_echo").isNotNull() & F.col("_here") & ~F.col("_echo").eqNullSafe(F.col("chunk_id")), F.lit("moved")),
    ))
    told = F.explode(F.concat(checks, F.coalesce("_wrong", F.array().cast("array<string>"))))
    nowhere = matrix.where("row is null").select(F.lit("surplus").alias("check"), F.lit(None).cast("string").alias("key"))
    return both.where("row is not null").select(told.alias("check"), F.col("row").cast("string").alias("key")).unionByName(nowhere)


def aligned(rows: DataFrame, matrix: DataFrame, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """The rows (without their place) by category with ``category_idx`` and ``score`` from the matrix; fails if it is not theirs."""
    require_columns(rows, "row", "chunk_id")
    require_empty(matrix_violations(rows, matrix, categories), "scores do not fit the rows")
    names, _ = _width(categories)
    told = rows.join(matrix.select("row", "scores"), "row").select(*(c for c in rows.columns if c != "row"), F.posexplode("scores").alias("category_idx", "score"))
    return told.withColumn("category", F.element_at(names, F.col("category_idx") + 1))


def evaluate_logits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probabilities (row, scores) and the mean loss (one row: ``loss``, ``valid``) of ``rows`` (row, labels, label_mask, logits).

    The loss is the binary cross-entropy of all unmasked entries, each weighing the same
    whatever batch it came in, in fixed point; 0 without any. Masked logits may be anything.
    """
    entries = rows.select(F.explode(F.arrays_zip("labels", "label_mask", "logits")).alias("e")).where("e.label_mask").select(F.col("e.labels").alias("y"), F.col("e.logits").alias("x"))
    loss = (1 - F.col("y")) * F.col("x") + F.log1p(F.exp(-F.abs("x"))) + F.greatest(-F.col("x"), F.lit(0.0))
    told = entries.agg(F.sum(fixed(loss).cast("decimal(38,0)")).alias("s"), F.count("*").alias("valid"))
    mean = F.when(F.col("valid") == 0, F.lit(0.0)).otherwise(F.col("s").cast("double") / (F.col("valid") * F.lit(float(SCALE))))
    return rows.select("row", F.transform("logits", sigmoid).alias("scores")), told.select(mean.alias("loss"), "valid")


def oof_rows(rows: DataFrame, predictions: DataFrame, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """Out-of-fold scores of ``rows`` (chunk_id, fold, ...) from each fold's ``predictions`` (fold, chunk_id, probabilities).

    Each fold's predictions must cover exactly that fold's rows, with a probability for each
    category. Returns the rows by category with ``score``.
    """
    names, width = _width(categories)
    own = rows.select("chunk_id", "fold").distinct()
    given = predictions.groupBy("chunk_id", "fold").agg(F.count("*").alias("_n"), F.max(F.col("probabilities").isNull() | (F.size("probabilities") != width) | _no_probability("probabilities")).alias("_wrong"))
    both = own.withColumn("_here", F.lit(True)).join(given, ["chunk_id", "fold"], "full")
    require_empty(both.where("_n is null or _here is null or _n > 1 or _wrong"), "predictions do not cover exactly their folds")
    met = rows.join(predictions.select("chunk_id", "fold", F.col("probabilities").alias("_p")), ["chunk_id", "fold"])  # a row per window and its array, before there is one per category
    kept = [c for c in met.columns if c != "_p"]
    told = met.select(*kept, F.posexplode("_p").alias("category_idx", "score"))
    return told.withColumn("category", F.element_at(names, F.col("category_idx") + 1))


def external_violations(predictions: DataFrame, run: Mapping, contracts: DataFrame, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """``check, key`` for an outside scorer's export (contract, chunk_id, probabilities) that is not the one its run names.

    The run's counts of windows and contracts must be those of the export and of
    ``contracts``; ids must be there, not empty and unique.
    """
    _, width = _width(categories)
    sizes = predictions.agg(F.count("*").alias("n")).crossJoin(contracts.agg(F.countDistinct("contract").alias("c")))  # a row each
    counts = sizes.select(F.explode(F.array_compact(F.array(F.when(F.col("n") != F.lit(run.get("chunks", -1)), F.lit("chunks")), F.when(F.col("c") != F.lit(run.get("contracts", -1)), F.lit("contracts"))))).alias("check"), F.lit("run").alias("key"))
    ids = predictions.groupBy("chunk_id").count().where("chunk_id is null or chunk_id = '' or count > 1").select(F.lit("chunk_id").alias("check"), F.col("chunk_id").alias("key"))
    wrong = predictions.where(F.col("contract").isNull() | F.col("probabilities").isNull() | (F.size("probabilities") != width) | _no_probability("probabilities")).select(F.lit("value").alias("check"), F.col("chunk_id").alias("key"))
    one, other = predictions.select("contract").distinct(), contracts.select("contract").distinct()
    cover = one.join(other, "contract", "left_anti").unionByName(other.join(one, "contract", "left_anti")).select(F.lit("cover").alias("check"), F.col("contract").alias("key"))
    return counts.unionByName(ids).unionByName(wrong).unionByName(cover)


def external_scores(predictions: DataFrame, run: Mapping, labels: DataFrame, categories: Iterable[str] = CATEGORIES) -> tuple[DataFrame, dict[str, float]]:
    """An outside scorer's contract scores with ``labels`` (contract, category, category_idx, label), and its frozen thresholds.

    ``run``: smoke, second_run, chunks, contracts, thresholds. Refuses smoke and second runs,
    thresholds outside 0 to 1 or not for exactly the categories, and what ``external_violations`` lists.
    """
    if run.get("smoke") is not False or run.get("second_run") is not False:
        raise ValueError("only the first full test run counts")
    names, _ = _width(categories)
    if not isinstance(run.get("thresholds"), Mapping):
        raise ValueError("the run names no thresholds")
    thresholds = threshold_values(run["thresholds"], categories)
    if max(thresholds.values()) > 1:
        raise ValueError("thresholds must lie in 0 to 1")
    require_empty(external_violations(predictions, run, labels, categories), "the export is not that of the run")
    told = predictions.select("contract", F.posexplode("probabilities").alias("category_idx", "score")).withColumn("category", F.element_at(names, F.col("category_idx") + 1))
    pooled = pool_contracts(told.withColumn("label", F.lit(0))).drop("label")
    return pooled.join(labels.select("contract", "category", "label"), ["contract", "category"]), thresholds
